"""Lossless reading and writing of delimited text.

Nothing is lost between reading and writing: encoding and byte order mark, delimiter, each record's line ending,
which fields were quoted, null (unquoted empty) against empty (""), blank lines and malformed records. Spark's CSV
reader keeps none of these, but its text reader hands out the raw bytes of lines, split by split, so files of any size
are read in parallel:

1. A first pass over the lines says of every split, for both states it may start in (between records, or inside a
   quoted field), in which it ends and how many records end in it. A quote inside an unquoted field is an ordinary
   character, so counting quotes would not do.
2. The states and record numbers at the starts of splits follow from these, a row a split.
3. A second pass parses each split. A record over the edge of splits comes in fragments, which meet by its number.

Lines end at line feeds, or at carriage returns in a file that has no line feed. Files in UTF-16 and UTF-32 have no such
lines; each is one task's work and must fit in its memory.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions.names import header_keys
from tabveil.operators.tables import cut, file_system, qualified

MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
DELIMITERS = (",", "\t", ";", "|")
SAMPLE_CHARS, SAMPLE_RECORDS, SAMPLE_BYTES = 256 << 10, 20, 4 << 10
MOST_CHARS = 1_000_000
#: Bytes of a file's head that its dialect is found in; bytes decoded at a time.
HEAD_BYTES, PIECE = 4 * SAMPLE_CHARS, 64 << 10
#: Windows-1252 with its five unassigned bytes as the control characters of the same number.
CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
RECORDS = "file string, _rec long, kind string, eol string, vals array<string>, quoted array<boolean>"


class DelimitedError(ValueError):
    """A value-free message: the kind of problem, the record and the field."""

    def __init__(self, kind: str, record: int = 0, field: int = 0):
        super().__init__(f"{kind} at record {record}" + (f", field {field}" if field else ""))
        self.kind, self.record, self.field = kind, record, field


@dataclass(frozen=True)
class Dialect:
    encoding: str = "utf-8"
    mark: bytes = b""
    delimiter: str = ","
    eol: str = "\r\n"


def decode(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", CP1252)[0] if encoding == "windows-1252" else data.decode(encoding)


def encode(s: str, encoding: str) -> bytes:
    return codecs.charmap_encode(s, "strict", codecs.charmap_build(CP1252))[0] if encoding == "windows-1252" else s.encode(encoding)


def detect_encoding(data: bytes, whole: bool = True) -> tuple[str, bytes]:
    """(encoding, mark). Of a head (not whole) the last character may be cut off."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, mark
    head = data[:SAMPLE_BYTES]
    pairs = len(head) // 2
    if pairs:
        even, odd = head[0 : 2 * pairs : 2].count(0), head[1 : 2 * pairs : 2].count(0)
        if odd >= 0.3 * pairs and even <= 0.05 * pairs:
            return "utf-16-le", b""
        if even >= 0.3 * pairs and odd <= 0.05 * pairs:
            return "utf-16-be", b""
    return "utf-8" if is_utf8(data, whole) else "windows-1252", b""


def is_utf8(data: bytes, whole: bool = True) -> bool:
    """Decoded piece by piece; a sequence may go over the edge of pieces, and over the end only of a head."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for a in range(0, len(data), PIECE):
            decoder.decode(data[a : a + PIECE])
        decoder.decode(b"", final=whole)
    except UnicodeDecodeError:
        return False
    return True


def _first_line(s: str) -> tuple[str, str]:
    quoted = False
    for m in re.finditer(r'"|\r\n|\r|\n', s):
        if m[0] == '"':
            quoted = not quoted
        elif not quoted:
            return s[: m.start()], m[0]
    return s, "\r\n"


def _outside(line: str, delimiter: str) -> int:
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def detect_dialect(data: bytes, whole: bool = True) -> Dialect:
    """The header decides the delimiter; ties go to the one whose first records best fit the header's width."""
    encoding, mark = detect_encoding(data, whole)
    try:
        sample = decode(data[len(mark) :], encoding)[:SAMPLE_CHARS]
    except UnicodeDecodeError:
        sample = data[len(mark) :].decode(encoding, "replace")[:SAMPLE_CHARS]
    line, eol = _first_line(sample)
    counts = [_outside(line, d) for d in DELIMITERS]
    tied = [d for d, n in zip(DELIMITERS, counts, strict=True) if n == max(counts)] if max(counts) else [","]

    def fits(d: str) -> int:
        n = 0
        try:
            for k, record in enumerate(parse(sample, d)):
                if k == 0:
                    width = len(record[1])
                elif k > SAMPLE_RECORDS:
                    break
                else:
                    n += len(record[1]) == width
        except DelimitedError:
            pass
        return n

    best = max(tied, key=lambda d: (fits(d), -tied.index(d))) if len(tied) > 1 else tied[0]
    return Dialect(encoding, mark, best, eol)


def parse(s: str, delimiter: str = ",", most_chars: int = MOST_CHARS) -> Iterator[tuple[int, list[str], list[bool], str]]:
    """(record, values, quoted, line ending). A quote inside an unquoted field is an ordinary character."""
    stop = re.compile(f"[{re.escape(delimiter)}\r\n]")
    at, record, n = 0, 0, len(s)
    while at < n:
        record += 1
        vals, quoted, size = [], [], 0
        while True:
            if at < n and s[at] == '"':
                start, parts = at + 1, []
                while True:
                    end = s.find('"', start)
                    if end < 0:
                        raise DelimitedError("UnclosedQuote", record, len(vals) + 1)
                    parts.append(s[start:end])
                    if s[end + 1 : end + 2] != '"':
                        break
                    parts.append('"')
                    start = end + 2
                at = end + 1
                if at < n and s[at] not in (delimiter, "\r", "\n"):
                    raise DelimitedError("TextAfterClosingQuote", record, len(vals) + 1)
                vals.append("".join(parts))
                quoted.append(True)
            else:
                m = stop.search(s, at)
                end = m.start() if m else n
                vals.append(s[at:end])
                quoted.append(False)
                at = end
            size += len(vals[-1])
            if size > most_chars:
                raise DelimitedError("RecordTooLarge", record)
            if at < n and s[at] == delimiter:
                at += 1
                continue
            break
        eol = "\r\n" if s.startswith("\r\n", at) else s[at : at + 1]
        at += len(eol)
        yield record, vals, quoted, eol


def _classified(path: str, record: int, vals: list[str], quoted: list[bool], eol: str, width: int) -> tuple:
    blank = width > 1 and vals == [""] and not quoted[0]
    kind = "header" if record == 1 else "blank" if blank else "data" if len(vals) == width else "malformed"
    return path, record, kind, eol, [None if v == "" and not q else v for v, q in zip(vals, quoted, strict=True)], quoted


def _parsed(data: bytes, d: Dialect, before: int, most_chars: int) -> Iterator[tuple[int, list[str], list[bool], str]]:
    """The records of data, numbered from before + 1; errors name their record."""
    try:
        s, cut_off = decode(data, d.encoding), False
    except UnicodeDecodeError as e:
        s, cut_off = decode(data[: e.start], d.encoding), True
    last = 0
    try:
        for record, vals, quoted, eol in parse(s, d.delimiter, most_chars):
            last = record
            if not cut_off or eol:
                yield before + record, vals, quoted, eol
    except DelimitedError as e:
        if not cut_off:
            raise DelimitedError(e.kind, before + e.record, e.field) from None
        last = e.record
    if cut_off:
        ended = not s or s[-1] in "\r\n"
        raise DelimitedError("UndecodableInput", before + last + ended)


def _whole(dialect: Dialect | None, most_chars: int):
    """Files that are one row each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part["path"], part["content"], strict=True):
                d = dialect or detect_dialect(data)
                if dialect and not data.startswith(d.mark):
                    raise DelimitedError("ByteOrderMark")
                rows, width = [], None
                for record, vals, quoted, eol in _parsed(data[len(d.mark) :], d, 0, most_chars):
                    width = width or len(vals)
                    rows.append(_classified(path, record, vals, quoted, eol, width))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows = []
                if width is None:
                    raise DelimitedError("MissingHeader", 1)
                yield pd.DataFrame(rows, columns=_NAMES)

    return run


_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
#: States between lines: a record begins, or a quoted field goes on. LOST is where no record can be.
OUT, IN, LOST = 0, 1, 2
_CLOSED = re.compile(rb'(?:[^"]++|"")*+"')


def crossed(line: bytes, state: int, delimiter: bytes) -> tuple[int, int, int, int]:
    """(state after the line, records that end in it, bytes up to the end of the first and of the last of them), of a
    line without its end (a line feed, or a carriage return where the file has no line feeds), which counts as a byte."""
    if state == LOST:
        return LOST, 0, 0, 0
    quote, end = b'"' in line, len(line)
    if state == IN and not quote:
        return IN, 0, 0, 0
    if state == OUT and not quote and line.find(b"\r", 0, end - 1) < 0:
        return OUT, 1, end + 1, end + 1
    n, first, last, at, inside = 0, 0, 0, 0, state == IN
    while True:
        if inside or line[at : at + 1] == b'"':
            m = _CLOSED.match(line, at + (not inside))
            if not m:
                return IN, n, first, last
            inside, stop = False, m.end()
            if stop < end and line[stop : stop + 1] not in (delimiter, b"\r"):
                return LOST, n, first, last
        else:
            stop = min((i for i in (line.find(delimiter, at), line.find(b"\r", at)) if i >= 0), default=end)
        if stop < end and line[stop : stop + 1] == delimiter:
            at = stop + 1
            continue
        # A record ends: at a carriage return of its own, or at the line feed, with or without a carriage return.
        at = stop + 1
        last = end + 1 if at >= end else at
        n, first = n + 1, first or last
        if last > end:
            return OUT, n, first, last


def _splits(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, start of the split, its lines): a task may hold several splits, one after another."""

    def rows():
        for part in parts:
            yield from zip(part["file"], part["start"], part["line"], strict=True)

    for (file, start), group in itertools.groupby(rows(), key=lambda r: (r[0], r[1])):
        yield file, int(start), (r[2] for r in group)


def _summaries(delimiters):
    """(file, start, bytes, utf8, out_end, out_n, in_end, in_n) of each split."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for file, start, lines in _splits(parts):
            delimiter, size, utf8 = delimiters.value[file], 0, True
            state, count = [OUT, IN], [0, 0]
            for line in lines:
                size += len(line) + 1
                utf8 = utf8 and (line.isascii() or is_utf8(line))
                ends = [crossed(line, s, delimiter) for s in state]
                state, count = [e[0] for e in ends], [c + e[1] for c, e in zip(count, ends, strict=True)]
            found.append((file, start, size, utf8, state[0], count[0], state[1], count[1]))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return run


SUMMARY = "file string, start long, bytes long, utf8 boolean, out_end int, out_n long, in_end int, in_n long"


@dataclass(frozen=True)
class _Split:
    dialect: Dialect
    width: int
    state: int
    before: int
    last: bool
    ends_in_line_feed: bool
    line_end: bytes


def _records_of(splits, most_chars: int):
    """The records that lie in a split; and as kind 'fragment', with its bytes as Latin-1 in vals, what the split has of
    records that go over its edges."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, start, lines in _splits(parts):
            if (file, start) not in splits.value:
                raise RuntimeError("the splits of a file have changed while it was read")
            x = splits.value[file, start]
            delimiter, state, record, opened = x.dialect.delimiter.encode(), x.state, x.before, x.state == IN
            rows, pending, open_bytes, buffer, size = [], [], 0, [], 0

            def fragment(n: int, data: list[bytes], file=file, start=start) -> tuple:
                return file, n, "fragment", "", [b"".join(data).decode("latin-1"), str(start)], []

            for piece, body in _with_ends(lines, x.dialect.mark if start == 0 else b"", not x.last or x.ends_in_line_feed, x.line_end):
                state, n, first, last = crossed(body, state, delimiter)
                if n:
                    if opened:
                        record, opened = record + 1, False
                        rows.append(fragment(record, [*pending, piece[:first]]))
                        complete = [piece[first:last]]
                    else:
                        complete = [*pending, piece[:last]]
                    buffer += complete
                    size += sum(map(len, complete))
                    pending, open_bytes = [], 0
                    piece = piece[last:]
                if piece:
                    pending.append(piece)
                    open_bytes += len(piece)
                if size >= 1 << 16:
                    for record, vals, quoted, eol in _parsed(b"".join(buffer), x.dialect, record, most_chars):
                        rows.append(_classified(file, record, vals, quoted, eol, x.width))
                    buffer, size = [], 0
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=_NAMES)
                    rows = []
                if state == LOST:
                    break
                if open_bytes > 16 * most_chars:
                    raise DelimitedError("RecordTooLarge", record + 1)
            for record, vals, quoted, eol in _parsed(b"".join(buffer), x.dialect, record, most_chars):
                rows.append(_classified(file, record, vals, quoted, eol, x.width))
            if pending:
                rows.append(fragment(record + 1, pending))
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


def _with_ends(lines: Iterator[bytes], mark: bytes, fed: bool, line_end: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(line with its end, line without); the last has one only if fed says so."""
    held = None
    for line in lines:
        if held is not None:
            yield held + line_end, held
        held = line.removeprefix(mark) if held is None and mark else line
    if held is not None:
        yield held + (line_end if fed else b""), held


def _joined(dialects, most_chars: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        file, record = pdf["file"].iloc[0], int(pdf["_rec"].iloc[0])
        d, width = dialects.value[file]
        data = b"".join(p[0].encode("latin-1") for p in sorted(pdf["vals"], key=lambda p: int(p[1])))
        return pd.DataFrame([_classified(file, n, vals, quoted, eol, width) for n, vals, quoted, eol in _parsed(data, d, record - 1, most_chars)], columns=_NAMES)

    return run


def _head(spark: SparkSession, path: str) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def _width(head: bytes, d: Dialect) -> int:
    """Fields of the header. head may end anywhere, so the rest of it does not matter."""
    s = head[len(d.mark) :].decode("latin-1")  # delimiters, quotes and line ends are ASCII
    try:
        first = next(parse(s, d.delimiter, 4 * MOST_CHARS), None)
    except DelimitedError as e:
        raise DelimitedError(e.kind if len(head) < HEAD_BYTES else "RecordTooLarge", 1, e.field) from None
    if first is None:
        raise DelimitedError("MissingHeader", 1)
    return len(first[1])


def _has_no(spark: SparkSession, path: str, char: str) -> bool:
    return spark.read.option("lineSep", "\r").text(path).filter(F.contains("value", F.lit(char))).isEmpty()


def read_records(spark: SparkSession, path: str, dialect: Dialect | None = None, most_chars: int = MOST_CHARS) -> DataFrame:
    """Every record of the files at path, read at once and written as a table: header, data, blank or malformed; values
    null where empty and unquoted. Each file has a header and, unless dialect says so, a dialect of its own."""
    return _read(spark, path, dialect, most_chars)[0]


def _read(spark: SparkSession, path: str, dialect: Dialect | None, most_chars: int) -> tuple[DataFrame, dict[str, Dialect]]:
    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"), "length").collect()  # no contents
    if not files:  # Spark lists no empty files
        raise DelimitedError("MissingHeader", 1)
    chosen, length = {}, {}
    for r in files:
        head = _head(spark, r["path"])
        if dialect and not head.startswith(dialect.mark):
            raise DelimitedError("ByteOrderMark")
        chosen[r["file"]], length[r["file"]] = dialect or detect_dialect(head, r["length"] <= len(head)), r["length"]
        if not r["length"] - len(chosen[r["file"]].mark):
            raise DelimitedError("MissingHeader", 1)
    wide = [r["path"] for r in files if chosen[r["file"]].encoding.startswith("utf-") and chosen[r["file"]].encoding != "utf-8"]
    narrow = [r for r in files if r["path"] not in set(wide)]
    found = []
    if wide:
        whole = spark.read.format("binaryFile").load(wide).select(F.col("_metadata.file_path").alias("path"), "content")
        found.append(whole.mapInPandas(_whole(dialect, most_chars), RECORDS))
    returns = [r for r in narrow if detect_dialect(_head(spark, r["path"]), False).eol == "\r" and _has_no(spark, r["path"], "\n")]
    for sep, group in (("\n", [r for r in narrow if r not in returns]), ("\r", returns)):
        if not group:
            continue
        text = spark.read.option("lineSep", sep).text([r["path"] for r in group])
        lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
        delimiters = spark.sparkContext.broadcast({f: d.delimiter.encode() for f, d in chosen.items()})
        splits, by_file = {}, defaultdict(list)
        for r in lines.mapInPandas(_summaries(delimiters), SUMMARY).collect():  # a row a split
            by_file[r["file"]].append(r)
        for r in group:
            file, parts = r["file"], sorted(by_file[r["file"]], key=lambda x: x["start"])
            d = chosen[file]
            if not dialect and not d.mark:
                d = replace(d, encoding="utf-8" if all(x["utf8"] for x in parts) else "windows-1252")
            chosen[file], width = d, _width(_head(spark, r["path"]), d)
            state, before, size = OUT, 0, sum(x["bytes"] for x in parts)
            for x in parts:
                # Spark's reader takes a mark in UTF-8 away.
                splits[file, x["start"]] = _Split(d, width, state, before, x is parts[-1], length[file] in (size, size + len(d.mark)), sep.encode())
                state, before = (x["out_end"], before + x["out_n"]) if state == OUT else (x["in_end"], before + x["in_n"]) if state == IN else (LOST, before)
        shared = spark.sparkContext.broadcast(splits)
        records = cut(lines.mapInPandas(_records_of(shared, most_chars), RECORDS), "split-records")
        dialects = spark.sparkContext.broadcast({f: (x.dialect, x.width) for (f, _), x in splits.items()})
        found += [records.filter("kind <> 'fragment'"), records.filter("kind = 'fragment'").groupBy("file", "_rec").applyInPandas(_joined(dialects, most_chars), RECORDS)]
    return cut(reduce(DataFrame.unionByName, found), "records"), chosen


@dataclass
class DelimitedTable:
    """rows has _rec and a string column per header key; records is the lossless form. columns are the names that the
    keys have in rows: Spark does not tell `Name` from `name`, so the later of such keys, and keys that would collide
    with _rec or hold a backtick, are named by their position."""

    rows: DataFrame
    records: DataFrame
    header: list[str]
    keys: list[str]
    dialect: Dialect
    columns: list[str]
    #: Whether these are all of the file's rows; bytes of it that were read, where not all were.
    whole: bool = True
    bytes_read: int | None = None

    def totals(self) -> DataFrame:
        """n_rows, n_blank, n_malformed and the first 100 malformed record numbers."""
        bad = [r["_rec"] for r in self.records.filter("kind = 'malformed'").orderBy("_rec").limit(100).select("_rec").collect()]
        count = lambda k: F.count_if(F.col("kind") == k)
        return self.records.agg(count("data").alias("n_rows"), count("blank").alias("n_blank"), count("malformed").alias("n_malformed")).withColumn("malformed_records", F.array(*map(F.lit, bad)).cast("array<bigint>"))


def column_names(keys: list[str]) -> list[str]:
    taken, out = {"_rec"}, []
    for i, k in enumerate(keys, 1):
        name = k
        while name.lower() in taken or "`" in name:
            name = f"_c{i}" if not name.startswith("_c") else name + "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_delimited(spark: SparkSession, path: str, skip_malformed: bool = False, most_chars: int = MOST_CHARS) -> DelimitedTable:
    """One file. A malformed record fails the read, by its number, unless skip_malformed."""
    records, dialects = _read(spark, path, None, most_chars)
    if not skip_malformed and (bad := records.filter("kind = 'malformed'").agg(F.min("_rec").alias("r")).first()["r"]):
        raise DelimitedError("FieldCountMismatch", bad)
    return _table(records, next(iter(dialects.values())))


def _table(records: DataFrame, dialect: Dialect) -> DelimitedTable:
    header = [v or "" for v in records.filter("kind = 'header'").first()["vals"]]
    keys = header_keys(header)
    columns = column_names(keys)
    rows = records.filter("kind = 'data'").select("_rec", *[F.element_at("vals", i).alias(c) for i, c in enumerate(columns, 1)])
    return DelimitedTable(rows, records, header, keys, dialect, columns)


#: Bytes that a look at the first rows reads to begin with; as many again each time they do not do.
FIRST_BYTES = 256 << 10


def _first_records(path: str, rows: int, most_chars: int):
    """The records up to data row `rows`, with the blank and malformed ones before the next, of a file that is read no
    further than about twice what they need; and a row of kind 'end' that says how much was read, and in which dialect."""

    def taken(data: bytes, ended: bool) -> tuple[Dialect, list[tuple], bool, bool]:
        """(dialect, records, whether they are enough, whether data rows follow)."""
        d = detect_dialect(data, ended)
        body = data[len(d.mark) :]
        if not ended and d.encoding != "windows-1252":
            body = encode(codecs.getincrementaldecoder(d.encoding)().decode(body), d.encoding)  # no character cut off
        found, width, n = [], None, 0
        try:
            for record, vals, quoted, eol in _parsed(body, d, 0, most_chars):
                width = width or len(vals)
                row = _classified(path, record, vals, quoted, eol, width)
                n += row[2] == "data"
                if n > rows:
                    return d, found, True, True
                found.append(row)
        except DelimitedError as e:
            if ended or e.kind != "UnclosedQuote":
                raise
        return d, found, ended, False  # what is read on begins again, so a record cut off here does no harm

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, file = file_system(path)
        for _ in parts:
            with where.open_input_stream(file, compression=None) as stream:
                data, enough = b"", False
                while not enough:
                    asked = max(FIRST_BYTES, len(data))
                    piece = stream.read(asked)
                    data += piece
                    d, found, enough, more = taken(data, len(piece) < asked)
            if not found:
                raise DelimitedError("MissingHeader", 1)
            yield pd.DataFrame([*found, (path, len(data), "end", d.eol, [d.encoding, d.mark.hex(), d.delimiter], [more])], columns=_NAMES)

    return run


def read_first(spark: SparkSession, path: str, rows: int, most_chars: int = MOST_CHARS) -> DelimitedTable:
    """The first data rows of a file, and the blank lines and malformed records before the next one, for previews and
    profiles: the rest of the file is not read. Malformed records are listed and never fail. The encoding is that of
    what was read. One task reads, since rows is a bound."""
    path = qualified(spark, path)
    one = spark.range(1).select(F.lit(path).alias("path"))
    found = cut(one.mapInPandas(_first_records(path, rows, most_chars), RECORDS), "first-records")
    end = found.filter("kind = 'end'").first()
    encoding, mark, delimiter = end["vals"]
    table = _table(found.filter("kind <> 'end'"), Dialect(encoding, bytes.fromhex(mark), delimiter, end["eol"]))
    return replace(table, whole=not end["quoted"][0], bytes_read=end["_rec"])


def field_text(v, was_quoted, delimiter: str):
    """Quoted if it was; else only if it must be, so that reading gives the same value."""
    needs = v.rlike(f"[{re.escape(delimiter)}\r\n]") | v.startswith('"')
    return F.when(v.isNull(), F.when(was_quoted, '""').otherwise("")).when(was_quoted | needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def encoded_records(records: DataFrame, dialect: Dialect) -> DataFrame:
    """(_rec, line): each record as text, with its own line ending."""
    fields = F.transform(F.arrays_zip("vals", "quoted"), lambda x: field_text(x["vals"], x["quoted"], dialect.delimiter))
    return records.select("_rec", F.concat(F.array_join(fields, dialect.delimiter), "eol").alias("line"))


def masked_records(table: DelimitedTable, rows: DataFrame) -> DataFrame:
    """The records of table with the values of rows (same _rec); header and blank lines as they were, malformed ones
    left out."""
    new = rows.select(F.col("_rec").alias("r"), F.array(*[F.col(f"`{c}`") for c in table.columns]).alias("new"))
    joined = table.records.filter("kind <> 'malformed'").join(new, (F.col("_rec") == F.col("r")) & (F.col("kind") == "data"), "left")
    return joined.select("_rec", "kind", "eol", F.coalesce("new", "vals").alias("vals"), "quoted")


PARTS = "rec long, temp string, bytes long"


def write_delimited(records: DataFrame, dialect: Dialect, folder: str) -> list[tuple[str, int]]:
    """Writes ordered parts below folder: text parts in the dialect's encoding, the first with the byte order mark. The
    parts, end to end in the order of their names, are the file; without records it is the mark alone. Returns the name
    and size of each part.

    Ranges of records are sorted and encoded in parallel and streamed out to files of attempts. Once all tasks are done,
    the files that they report get the names of parts; if any fails, no part appears. A record without a line ending
    may only be the last. folder must be new.
    """
    from pyarrow import fs as afs

    spark = records.sparkSession
    folder = qualified(spark, folder)
    where, root = file_system(folder)
    if where.get_file_info(root).type == afs.FileType.Directory and where.get_file_info(afs.FileSelector(root)):
        raise FileExistsError(f"{folder} is not empty")
    most, early = records.agg(F.max("_rec"), F.min(F.when(F.col("eol") == "", F.col("_rec")))).first()
    if early is not None and early < most:
        raise DelimitedError("UnterminatedRecord", early)
    attempts = f"{root}/_attempts"
    where.create_dir(attempts, recursive=True)
    encoding, mark = dialect.encoding, dialect.mark

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = file_system(folder)
        out, size, first, temp = None, 0, 0, f"{root}/_attempts/{uuid.uuid4().hex}"
        for part in parts:
            for rec, line in zip(part["_rec"], part["line"], strict=True):
                if out is None:
                    first, out = int(rec), where.open_output_stream(temp, compression=None)
                    size += out.write(mark if rec == 1 else b"") or 0
                try:
                    size += out.write(encode(line, encoding)) or 0
                except UnicodeEncodeError:
                    raise DelimitedError("UnencodableOutput", rec) from None
        if out is not None:
            out.close()
            yield pd.DataFrame({"rec": [first], "temp": [temp], "bytes": [size]})

    try:
        if most is None:
            with where.open_output_stream(f"{attempts}/mark", compression=None) as f:
                f.write(mark)
            done = [(0, f"{attempts}/mark", len(mark))]
        else:
            lines = encoded_records(records, dialect)
            n = max(1, lines.rdd.getNumPartitions())
            dealt = lines.repartitionByRange(n, "_rec").sortWithinPartitions("_rec")
            done = [tuple(r) for r in dealt.mapInPandas(run, PARTS).orderBy("rec").collect()]  # a row a part
        named = [(f"{root}/part-{rec:012d}", size) for rec, _, size in done]
        for (name, _), (_, temp, _) in zip(named, done, strict=True):
            where.move(temp, name)
    finally:
        where.delete_dir(attempts)
    return named


def join_parts(spark: SparkSession, folder: str, target: str) -> int:
    """Makes the parts that write_delimited left below folder one file; its size. Where files can be written at any
    place (local and mounted file systems) tasks copy parts to their places in parallel; where the file system can join
    files (HDFS) it does; elsewhere the parts have to do. The file appears under its name when it is complete; on file
    systems that join, the parts become part of it."""
    from pyarrow import fs as afs

    folder, target = qualified(spark, folder), qualified(spark, target)
    where, root = file_system(folder)
    parts = sorted((f.path, f.size) for f in where.get_file_info(afs.FileSelector(root)) if f.base_name.startswith("part-"))
    ends = list(itertools.accumulate(size for _, size in parts))
    temp = f"{target}.{uuid.uuid4().hex}"
    if not target.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        sources = spark._gateway.new_array(path, len(parts))
        for i, (p, _) in enumerate(parts):
            sources[i] = path(p)
        files.create(path(temp)).close()
        files.concat(path(temp), sources)  # fails where it is not supported
        files.rename(path(temp), path(target))
        return ends[-1]
    local = file_system(temp)[1]
    with open(local, "wb") as f:
        f.truncate(ends[-1] if ends else 0)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in rows:
            for part, at in zip(row["part"], row["at"], strict=True):
                with open(part, "rb") as source, open(local, "r+b") as out:
                    out.seek(at)
                    while piece := source.read(1 << 20):
                        out.write(piece)
            yield pd.DataFrame({"parts": [len(row)]})

    try:
        placed = spark.createDataFrame([(p, end - size) for (p, size), end in zip(parts, ends, strict=True)], "part string, at long")
        if parts:
            placed.repartition(len(parts)).mapInPandas(run, "parts int").collect()
        os.replace(local, file_system(target)[1])
    finally:
        if os.path.exists(local):
            os.remove(local)
    return ends[-1] if ends else 0


def masked_name(name: str) -> str:
    """The name of the masked copy of a file: <stem>_masked and .csv, .txt or .tsv as before, else .csv."""
    stem, dot, kind = name.rpartition(".")
    return f"{stem if dot else name}_masked.{kind.lower() if kind.lower() in ('csv', 'txt', 'tsv') else 'csv'}"
