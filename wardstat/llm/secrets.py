"""Secret scan: patterns of known secrets, and high-entropy stretches found by
a sliding window of Shannon entropy per character class.

* Patterns (``assign``, ``access``, ``hex``): leftmost non-overlapping matches of
  each kind over the whole text, those too short dropped.
* Method (``entropy``): candidates are long runs of token characters.  A
  candidate's class (hexadecimal, upper case, any) gives its threshold.  A
  window slides over the candidate; the counts of its characters, and the sum
  from which the entropy follows, are updated by the character that enters
  and the one that leaves.  The span is from the first window at or above
  the threshold to the end of the last.  Candidates that match the allow-list
  (plain words, identifiers made of words, UUIDs, placeholders) are skipped.

Only DataFrame functions are used and nothing is shuffled: each text is
scanned where it is read.  Positions count code points.

Null texts count as empty and have no span.  Rows are scanned one by one, so
ids may repeat or be null; other columns do not matter.  Marker characters
(U+0001, U+0002) that occur in a text are taken as U+0003 during the scan,
which no pattern matches.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import pick, text_of

# The patterns, by kind, in the order in which kinds are listed.
PATTERNS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
              r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
KINDS = [*PATTERNS, "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# class -> (pattern, alphabet, bits from which a window counts), first that fits
CLASSES = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 3.0),
    "upper": ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    "any": ("", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.8),
}
ALLOWED = [
    r"^[A-Za-z]+$",                                             # one word
    r"^[/_=+-]*[A-Za-z]+([/_=+-]+[A-Za-z]+)*[/_=+-]*$",         # words and separators
    r"^[0-9/_=+-]+$",                                           # numbers, dates, rules
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",    # UUID
    r"(?i)example|sample|placeholder|changeme|xxxx|0000000|1234567",
]
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Exclusive running sums of an array, in blocks, so that the arrays which
    grow during the fold stay short."""
    return _let(lengths, _block_starts)


def _block_starts(lengths: Column) -> Column:
    def running(values, first):
        return F.aggregate(
            values, F.struct(first.alias("s"), F.array().cast("array<int>").alias("a")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"),
                                    F.concat(acc["a"], F.array(acc["s"])).alias("a")),
            lambda acc: acc["a"])

    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last),
                         lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def total(block):
        return F.aggregate(block, F.lit(0), lambda s, v: s + v)

    return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, total),
                                                                   F.lit(0)), running)))


def _marked(text: Column, pattern: str) -> Column:
    """The text cut where a match begins; a match ends at the closing mark."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)


def _matches(pieces: Column) -> Column:
    """array<struct<start, end, s>> of the matches in ``_marked`` text."""
    lengths = F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
    own = F.transform(pieces, lambda p: F.substring_index(p, CLOSE, 1))
    spans = F.transform(
        F.arrays_zip(_starts(lengths).alias("start"), own.alias("s")),
        lambda x: F.struct(x["start"].alias("start"),
                           (x["start"] + F.length(x["s"])).alias("end"), x["s"].alias("s")))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return F.when(F.size(pieces) > 1, F.slice(spans, 2, F.size(pieces))).otherwise(none)


def _class_value(s: Column, at: int) -> Column:
    """Value ``at`` of the class of a candidate."""
    out = F.lit(CLASSES["any"][at])
    for name in ("upper", "hex"):
        out = F.when(s.rlike(CLASSES[name][0]), F.lit(CLASSES[name][at])).otherwise(out)
    return out


def _hot_stretch(s: Column) -> Column:
    """struct<first, last>: from the first window of a candidate at or above its
    class's threshold to the end of the last one; nulls if there is none."""
    codes = _let(_class_value(s, 1), lambda alphabet: F.transform(
        F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1))
    return _let(F.struct(codes.alias("codes"), _class_value(s, 2).alias("threshold")),
                lambda x: _slide_window(x["codes"], x["threshold"]))


def _slide_window(codes: Column, threshold: Column) -> Column:
    # c * log2(c) for every count a window and the entering character can have
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    width = max(len(a) for _, a, _ in CLASSES.values())
    start = F.struct(F.array_repeat(F.lit(0), width).alias("counts"), F.lit(0.0).alias("sum"),
                     F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"),
                     F.lit(None).cast("int").alias("last"))

    def slide(acc, enters):
        at = acc["at"]
        leaves = F.when(at >= WINDOW, F.get(codes, at - WINDOW)).otherwise(F.lit(-1))
        had = F.get(acc["counts"], enters)
        has = F.get(acc["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        total = (acc["sum"] + F.get(weight, had + 1) - F.get(weight, had)
                 + F.when(at >= WINDOW, F.get(weight, has - 1) - F.get(weight, has))
                 .otherwise(0.0))
        hot = (at >= WINDOW - 1) & (
            F.lit(math.log2(WINDOW)) - total / WINDOW >= threshold - 1e-9)
        return F.struct(
            F.transform(acc["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0)
                        - F.when(k == leaves, 1).otherwise(0)).alias("counts"),
            total.alias("sum"), (at + 1).alias("at"),
            F.when(hot & acc["first"].isNull(), at - (WINDOW - 1)).otherwise(acc["first"])
            .alias("first"),
            F.when(hot, at + 1).otherwise(acc["last"]).alias("last"))

    return F.aggregate(codes, start, slide,
                       lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _allowed(s: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | s.rlike(pattern)
    return out


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``text`` (null: empty) and
    ``spans``: array<struct<start, kindno, end, kind>> in order."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       text_of(f"`{text_col}`").alias("text"))
    marks = F.col("text").contains(OPEN) | F.col("text").contains(CLOSE)
    scan = rows.withColumn("scan", F.when(marks, F.translate("text", OPEN + CLOSE, OTHER * 2))
                           .otherwise(F.col("text")))
    pieces = scan.select("row", "text", *[_marked(F.col("scan"), p).alias(k) for k, p in
                                          [*PATTERNS.items(), ("candidate", CANDIDATE)]])
    found = pieces.select("row", "text", *[_matches(F.col(k)).alias(k)
                                           for k in [*PATTERNS, "candidate"]])
    long_enough = {
        "assign": lambda x: F.length(F.regexp_extract(x["s"], PATTERNS["assign"], 2)) >= 8,
        "access": lambda x: F.length(x["s"]) >= 16,
        "hex": lambda x: F.length(x["s"]) >= 32,
    }

    def spans(matches, kind):
        no = KINDS.index(kind)
        return F.transform(matches, lambda x: F.struct(
            x["start"].alias("start"), F.lit(no).alias("kindno"), x["end"].alias("end"),
            F.lit(kind).alias("kind")))

    base = [spans(F.filter(k, long_enough[k]), k) for k in PATTERNS]
    hot = F.transform(F.filter("candidate", lambda x: ~_allowed(x["s"])), lambda x: F.struct(
        x["start"].alias("start"), _hot_stretch(x["s"]).alias("hot")))
    stretches = F.transform(F.filter(hot, lambda x: x["hot"]["first"].isNotNull()),
                            lambda x: F.struct((x["start"] + x["hot"]["first"]).alias("start"),
                                               (x["start"] + x["hot"]["last"]).alias("end")))
    return found.select("row", "text", F.array_sort(
        F.concat(*base, spans(stretches, "entropy"))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy,
    base_sha256 (of the patterns' spans as ``kind:start:end``), spans (all)."""
    found = secret_spans(pick(docs, dict.fromkeys([id_col, text_col])), text_col)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"),
                        *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text",
                   placeholder: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span in its texts replaced (spans that overlap by one
    placeholder); rows without a span come out unchanged."""
    found = secret_spans(docs, text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        apart = (x["start"] >= acc["at"]) | (F.size(acc["parts"]) == 0)
        kept = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(apart, F.concat(acc["parts"], F.array(kept, F.lit(placeholder))))
            .otherwise(acc["parts"]).alias("parts"))

    folded = F.aggregate("spans", start, step)
    out = found.withColumn("folded", F.when(F.size("spans") > 0, folded))
    text = F.when(F.col("folded").isNull(), F.col(f"row.`{text_col}`").cast("string")).otherwise(
        F.concat(F.concat_ws("", F.col("folded.parts")),
                 F.substring("text", F.col("folded.at") + 1, F.length("text"))))
    return out.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c)
                        for c in docs.columns])
