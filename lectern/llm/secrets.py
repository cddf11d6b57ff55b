"""Secret scans: base patterns, and weak parts that count only where complementary parts stand together.

A Python pass over Arrow batches finds the spans of the base kinds, weak parts (access identifiers, secrets and endpoints
that alone would be too common to report) and the scopes that the text itself marks: outermost `{...}` objects and
`[section]` blocks. Spark links the parts by two interval joins inside each document: parts of different classes belong
together if one marked scope holds both, or if they stand at most `SCOPE` characters apart. Weak parts with a partner
become spans of their own. A plain web address is no endpoint; one with credentials, of a database or queue, or named as
host, endpoint, server or url is. Spans count code points, end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; extra columns are
ignored by `scan` and kept by `redact`, whatever their names; rows without an id are told apart by their text; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import materialize

SCOPE = 300

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "weak_access", "weak_secret", "weak_endpoint"]
#: Class of each kind: parts of different classes complement each other.
CLASSES = ["secret", "access", "secret", "access", "secret", "endpoint"]

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

WEAK_ACCESS = re.compile(r"""\b(?:access[_-]?(?:key[_-]?)?id|client[_-]?id|key[_-]?id|user(?:name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{6,}""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])", re.ASCII)
WEAK_ENDPOINT = re.compile(r"""\b(?:postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?|amqps?|s3)://[^\s"'<>]+|\bhttps?://[^\s"'<>/@]+@[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?(?:https?://)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}""", re.IGNORECASE | re.ASCII)
SECTION = re.compile(r"^\[[^\]\n]+\][\x20\t\r]*$", re.MULTILINE)
BRACE = re.compile(r"[{}]")


def marked_scopes(text: str) -> list[tuple[int, int]]:
    """(start, end) of outermost balanced objects, and of sections up to the next one."""
    out, depth, start = [], 0, 0
    if "{" in text:
        for m in BRACE.finditer(text):
            if m[0] == "{":
                if not depth:
                    start = m.start()
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    out.append((start, m.end()))
    heads = [m.start() for m in SECTION.finditer(text)] if "[" in text else []
    return out + list(zip(heads, [*heads[1:], len(text)][: len(heads)], strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    low, out = text.lower(), []
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak parts; they are findings only once they are linked."""
    out = [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)]
    if ":" in text or "=" in text:
        out += [(m.start(), 3, m.end()) for m in WEAK_ACCESS.finditer(text)] if re.search("id|user", text, re.IGNORECASE | re.ASCII) else []
        out += [(m.start(), 5, m.end()) for m in WEAK_ENDPOINT.finditer(text)]
    return sorted(out)


def signed(x: int) -> int:
    """A 64-bit digest as Spark's xxhash64() gives it."""
    return x - (1 << 64) if x >> 63 else x


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, base, weak, scopes): spans of each row; id and digest of the text together name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                spans = [[{"start": a, "kind": k, "end": b} for a, k, b in f(t)] for f in (base_spans, weak_parts) for t in texts]
                weak = spans[len(texts) :]
                scopes = [[{"start": a, "kind": 0, "end": b} for a, b in marked_scopes(t)] if w else [] for t, w in zip(texts, weak, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array([signed(xxhash.xxh64_intdigest(t, seed=42)) for t in texts], pa.int64()), *[pa.array(s, pa.list_(SPAN)) for s in (spans[: len(texts)], weak, scopes)]],
                    names=["id", "digest", "base", "weak", "scopes"],
                )

    span = "array<struct<start: int, kind: int, end: int>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, digest long, base {span}, weak {span}, scopes {span}")


def _same() -> Column:
    """Rows of one text; the other side of a join has its columns with an underscore in front."""
    return F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(id, digest, linked): weak parts with a part of another class in one marked scope or at most scope characters away."""
    kinds = F.array(*[F.lit(c) for c in CLASSES])
    some = parts.where(F.size("weak") > 0)
    both = some.select("id", "digest", F.explode(F.concat("base", "weak")).alias("s"), "scopes").distinct()
    both = both.select("id", "digest", "s", F.element_at(kinds, F.col("s.kind") + 1).alias("class"), "scopes")

    def windows(more: int) -> Column:
        """Windows that the part touches, and some more on each side."""
        return F.sequence((F.col("s.start") / scope).cast("int") - more, (F.col("s.end") / scope).cast("int") + more)

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])

    near = named(both.drop("scopes").withColumn("window", F.explode(windows(1))))
    weak = both.drop("scopes").where(F.col("s.kind") > 2).withColumn("window", F.explode(windows(0)))
    gap = F.greatest(F.col("_s.start") - F.col("s.end"), F.col("s.start") - F.col("_s.end"))
    other_class = F.col("class") != F.col("_class")
    close = weak.join(near, _same() & (F.col("window") == F.col("_window")) & other_class & (gap <= scope) & (gap >= 0), "left_semi")

    held = both.withColumn("scope", F.explode("scopes")).where((F.col("scope.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("scope.end"))).drop("scopes")
    inside, other = held.where(F.col("s.kind") > 2), named(held)
    joint = inside.join(other, _same() & (F.col("scope") == F.col("_scope")) & other_class, "left_semi")
    return close.select("id", "digest", "s").union(joint.select("id", "digest", "s")).groupBy("id", "digest").agg(F.collect_set("s").alias("linked"))


def span_text(spans: Column) -> Column:
    """`kind:start:end` of spans, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _scanned(docs: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """(id, digest, base, spans) of each row."""
    parts = materialize(find_parts(docs, id_col, text_col), "parts")
    links = link_parts(parts, scope).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "linked")
    joined = parts.join(links, _same(), "left")
    return joined.select("id", "digest", "base", F.sort_array(F.concat("base", F.coalesce("linked", F.expr("array()")))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, digest, base, spans) of each row: the base spans and all spans."""
    return _scanned(docs, id_col, text_col, scope).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by mark (overlapping spans together); other columns stay as they are."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # names of the table cannot clash inside
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    found = _scanned(docs, id_col, text_col, SCOPE).where(F.size("spans") > 0).select("id", "digest", "spans").distinct()
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        new = s["start"] >= done["at"]
        between = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        return F.struct(F.when(new, F.concat(done["out"], between, F.lit(mark))).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    marked = F.aggregate("spans", start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    joined = rows.join(found, F.col("row").getField(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("digest")), "left")
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    return joined.select(*[F.when(F.col("spans").isNull(), v).otherwise(marked).alias(c) if c == text_col else v.alias(c) for c, v in fields.items()])
