"""Secrets in texts: fixed forms, and runs of characters that pass for random.

Three fixed forms are found by patterns: assignments, access keys and hex strings. Beside them, every long
run of key-like characters is read in the narrowest of seven encodings (decimal, hex, base32, lower-case or upper-case base36,
base62, base64; dashes between groups of equal length are no symbols) and put to a battery: chi-squared uniformity
of its symbols over equal cells, and of its kinds of symbols (digits, upper case, lower case, signs); the number of runs of high and low
symbols; and the correlation of neighbouring symbols. The smallest of the four p-values, times four, says how well the
run passes for random symbols. Within each encoding and band of lengths, Benjamini and Hochberg's procedure over all documents throws out the
runs that do not; its level is stricter for longer runs, whose tests see more. The rest are reported. The procedure
thus bounds the share of random runs among those thrown out, not the share of plain ones among those reported.

Everything is DataFrame expressions; only the few runs, not texts, are looked at twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# The forms that the contract names. A greedy match takes a whole run, so a minimum length
# in the pattern drops just those runs that are too short.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
# The alphabets of the encodings, in the order in which a run is tried.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "base62": DIGITS + UPPER + LOWER, "base64": DIGITS + UPPER + LOWER + "+/",
}
READS = {"decimal": "[0-9]+", "hex": "[0-9a-f]+|[0-9A-F]+", "base32": "[A-Z2-7]+", "base36": "[0-9a-z]+", "BASE36": "[0-9A-Z]+", "base62": "[0-9A-Za-z]+"}
#: A run of groups of one length with dashes between, and the five groups of a UUID.
DASHED = "|".join(["[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", *(rf"[0-9A-Za-z]{{{n}}}(?:-[0-9A-Za-z]{{{n}}})+" for n in (4, 5, 6, 8))])
CELLS = 8
#: Lengths at which a band begins, and the level of the procedure in it.
BANDS = ((0, 0.1), (32, 0.05), (48, 0.02), (96, 0.01))
#: p-values are counted in bins of this many to a factor of ten, up to 10^-30.
BINS, LAST_BIN = 10, 300

_SPANS = "array<struct<start:long,end:long,kind:int,value:string>>"


def running(values: Column, join, first: int) -> Column:
    """The running sums (or the like, by join) of an array of longs.

    SQL's fold copies the array that it grows, so the values are folded in about sqrt(n) parts of about sqrt(n), and the parts
    are put together by the running sums of their totals: n^1.5 copied numbers, not n^2.
    """

    def fold(xs: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(xs, start, lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(first).cast("long")), x))))

    def in_parts(one: Column) -> Column:
        xs, width = one["xs"], one["width"]
        inner = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda i: fold(F.slice(xs, i * width + 1, width)))
        return F.struct(inner.alias("inner"), fold(F.transform(inner, lambda p: F.element_at(p, -1))).alias("totals"))

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    # arrays of one struct hold what is used twice, so that it is worked out once
    parts = F.transform(F.transform(F.array(F.struct(values.alias("xs"), width.alias("width"))), in_parts), lambda r: F.transform(r["inner"], lambda p, i: F.transform(p, lambda v: join(F.when(i > 0, F.get(r["totals"], i - 1)).otherwise(F.lit(first).cast("long")), v))))
    return F.when(F.size(values) > 0, F.flatten(F.get(parts, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def spans(text: str, hits: str, pattern: str, kind: int, values: str | None = None) -> Column:
    """Places (code points, end exclusive) of the matches `hits` of pattern in text.

    The stretches between matches come from splitting by the same pattern; running sums of lengths are the places.
    """
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.col(hits), lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long"))
    pieces = F.arrays_zip(running(lengths, _sum, 0).alias("end"), F.col(hits).alias("hit"), F.col(values or hits).alias("value"))
    found = F.transform(pieces, lambda x: F.struct((x["end"] - F.char_length(x["hit"])).alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    return F.when(F.size(hits) > 0, found.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def apart(runs: str, base: str) -> Column:
    """Those of runs that overlap none of base, by one pass over both in order of place.

    Before a run's end all spans begin that may overlap it; it is apart if the largest of their ends is no more than its start.
    """
    none = F.lit(None).cast("string")
    marks = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("other"), none.alias("value"))),
            F.transform(runs, lambda r: F.struct(r["end"].alias("at"), F.lit(0).alias("is_base"), r["start"].alias("other"), r["value"].alias("value"))),
        )
    )

    def free(one: Column) -> Column:
        reach = running(F.transform(one["marks"], lambda m: F.when(m["is_base"] == 1, m["other"]).otherwise(F.lit(-1).cast("long"))), F.greatest, -1)
        both = F.filter(F.arrays_zip(one["marks"].alias("m"), reach.alias("reach")), lambda x: (x["m"]["is_base"] == 0) & (x["reach"] <= x["m"]["other"]))
        return F.transform(both, lambda x: F.struct(x["m"]["other"].alias("start"), x["m"]["at"].alias("end"), F.lit(3).alias("kind"), x["m"]["value"].alias("value")))

    found = F.get(F.transform(F.array(F.struct(marks.alias("marks"))), free), F.lit(0))
    return F.when(F.size(base) == 0, F.col(runs)).when(F.size(runs) == 0, F.col(runs)).otherwise(found.cast(_SPANS))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(value: Column) -> Column:
    """Struct (encoding, length, p) of a run of key-like characters; encoding is the place in ALPHABETS; p = 0 for fewer than eight symbols."""
    names = list(ALPHABETS)

    def reading(bare: Column) -> Column:
        found = F.lit(len(names) - 1)
        for k, name in reversed(list(enumerate(names[:-1]))):
            found = F.when(bare.rlike(f"^(?:{READS[name]})$"), k).otherwise(found)
        plain = F.when(found == names.index("hex"), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
        return F.struct(found.alias("encoding"), plain.alias("plain"))

    def by_encoding(r: Column, values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), r["encoding"])

    def symbols(r: Column) -> Column:
        size = by_encoding(r, [len(a) for a in ALPHABETS.values()])
        v = F.filter(F.transform(F.split(r["plain"], ""), lambda c: (F.instr(by_encoding(r, list(ALPHABETS.values())), c) - 1).cast("long")), lambda s: s >= 0)
        return F.struct(r["encoding"].alias("encoding"), r["plain"].alias("plain"), size.alias("size"), v.alias("v"), F.size(v).cast("double").alias("n"))

    def averaged(r: Column) -> Column:
        # the mean is a field of its own: as an expression, the lambdas that use it would sum it up anew for every symbol
        return F.struct(*(r[c].alias(c) for c in ("encoding", "plain", "size", "v", "n")), (F.aggregate(r["v"], F.lit(0.0), lambda a, s: a + s) / r["n"]).alias("mean"))

    # of each encoding the share of symbols in each cell, and in each kind of symbol
    cell_shares = [[sum(s * CELLS // len(a) == c for s in range(len(a))) / len(a) for c in range(CELLS)] for a in ALPHABETS.values()]
    kinds = ["[^0-9]", "[^A-Z]", "[^a-z]", "[0-9A-Za-z]"]
    kind_shares = [[sum(x in k for x in a) / len(a) for k in (DIGITS, UPPER, LOWER, "+/")] for a in ALPHABETS.values()]

    def table(r: Column, shares: list[list[float]]) -> Column:
        return F.get(F.array(*(F.array(*map(F.lit, row)) for row in shares)), r["encoding"])

    def chi2(counts: Column, shares: Column, n: Column) -> Column:
        return F.aggregate(F.zip_with(counts, shares, lambda c, x: F.when(x > 0, (c - n * x) * (c - n * x) / (n * x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

    def sums(r: Column) -> Column:
        count = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.size(F.filter(r["v"], lambda s: F.floor(s * CELLS / r["size"]) == c)).cast("double"))
        of_kind = F.array(*(F.length(F.regexp_replace(r["plain"], k, "")).cast("double") for k in kinds))
        mean = r["mean"]
        high = F.size(F.filter(r["v"], lambda s: s * 2 >= r["size"])).cast("double")
        pairs = F.zip_with(F.slice(r["v"], F.lit(1), (r["n"] - 1).cast("int")), F.slice(r["v"], F.lit(2), (r["n"] - 1).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            r["encoding"].alias("encoding"), r["n"].alias("n"), chi2(count, table(r, cell_shares), r["n"]).alias("cells"), chi2(of_kind, table(r, kind_shares), r["n"]).alias("kinds"),
            by_encoding(r, [float(sum(x > 0 for x in row) - 1) for row in kind_shares]).alias("df"), high.alias("high"), (r["n"] - high).alias("low"),
            (F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= r["size"]) != (p["b"] * 2 >= r["size"]))) + 1).cast("double").alias("runs"),
            F.aggregate(r["v"], F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean)).alias("var"),
            F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)).alias("cov"),
        )

    def beyond(x2: Column, df: Column) -> Column:
        """P of a larger chi-squared (Wilson and Hilferty); 1 without a degree of freedom."""
        k = 2 / (9 * F.greatest(df, F.lit(1.0)))
        return F.when(df > 0, upper_tail((F.pow(x2 / F.greatest(df, F.lit(1.0)), F.lit(1 / 3)) - (1 - k)) / F.sqrt(k))).otherwise(1.0)

    def tests(r: Column) -> Column:
        expected = 2 * r["high"] * r["low"] / r["n"] + 1
        spread = (expected - 1) * (expected - 2) / (r["n"] - 1)
        runs = F.when(spread > 0, 2 * upper_tail(F.abs(r["runs"] - expected) / F.sqrt(spread))).otherwise(0.0)
        serial = F.when(r["var"] > 0, 2 * upper_tail(F.abs(r["cov"] / r["var"] + 1 / r["n"]) * F.sqrt(r["n"]))).otherwise(0.0)
        least = F.least(beyond(r["cells"], F.lit(CELLS - 1.0)), beyond(r["kinds"], r["df"]), runs, serial)
        return F.struct(r["encoding"].alias("encoding"), r["n"].cast("long").alias("length"), F.least(F.lit(1.0), 4 * least).alias("p"))

    # arrays of one value hold what is used twice, so that it is worked out once
    bare = F.array(F.regexp_replace(value, "=+$", ""))
    undashed = F.transform(bare, lambda b: F.when(b.rlike(f"^(?:{DASHED})$"), F.replace(b, F.lit("-"), F.lit(""))).otherwise(b))
    read = F.transform(F.transform(undashed, reading), symbols)
    enough = F.filter(read, lambda r: r["n"] >= 8)
    none = F.struct(F.lit(len(names) - 1).alias("encoding"), F.lit(0).cast("long").alias("length"), F.lit(0.0).alias("p"))
    return F.coalesce(F.get(F.transform(F.transform(F.transform(enough, averaged), sums), tests), F.lit(0)), none)


def _band(length: Column) -> Column:
    band = F.lit(0)
    for i, (start, _) in enumerate(BANDS):
        band = F.when(length >= start, i).otherwise(band)
    return band


def _bin(p: Column) -> Column:
    return F.least(F.lit(LAST_BIN), F.floor(-BINS * F.log10(F.greatest(p, F.lit(1e-31))))).cast("int")


def not_random(runs: DataFrame) -> DataFrame:
    """For each encoding and band the bin from which runs (encoding, length, p) are thrown out: (encoding, band, cut).

    p-values are rounded up to the edge of their bin, which keeps to the level. At most 28 rows come of
    any number of runs.
    """
    binned = runs.groupBy("encoding", _band(F.col("length")).alias("band"), _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "band")
    from_top = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    level = F.element_at(F.array(*(F.lit(a) for _, a in BANDS)), F.col("band") + 1)
    passed = binned.withColumn("all", F.sum("n").over(group)).withColumn("these", F.sum("n").over(from_top)).where(F.pow(F.lit(10.0), -F.col("bin") / BINS) * F.col("all") <= level * F.col("these"))
    return passed.groupBy("encoding", "band").agg(F.min("bin").alias("cut"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and spans, an array of (start, end, kind, value) by start, then kind.

    kind is the place in KINDS; end is exclusive; both count code points. Spans of the first three kinds may
    overlap each other; a run of kind random overlaps none of them. A null text counts as empty and has
    no spans. Repeated rows and ids are scanned one by one; a null id stays null. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(ASSIGN), 0).alias("h0"), F.regexp_extract_all("text", F.lit(ASSIGN), 2).alias("v0"),
        F.regexp_extract_all("text", F.lit(ACCESS), 0).alias("h1"), F.regexp_extract_all("text", F.lit(HEX), 0).alias("h2"), F.regexp_extract_all("text", F.lit(RUN), 0).alias("h3"),
    )
    base = F.concat(
        F.filter(spans("text", "h0", ASSIGN, 0, "v0"), lambda s: F.char_length(s["value"]) >= LEAST_VALUE), spans("text", "h1", ACCESS, 1), spans("text", "h2", HEX, 2)
    )
    rows = rows.select("doc_id", base.alias("base"), spans("text", "h3", RUN, 3).alias("runs"))
    rows = rows.select("doc_id", "base", apart("runs", "base").alias("free"))
    rows = staged(rows.select("doc_id", "base", F.transform("free", lambda r: F.struct(r.alias("span"), battery(r["value"]).alias("test"))).alias("runs")), "runs")
    cuts = not_random(rows.select(F.explode("runs").alias("r")).select("r.test.*"))
    limits = cuts.collect()  # a row for each encoding and band at most

    def passes(r):
        test = r["test"]
        cut = F.lit(LAST_BIN + 1)
        for x in limits:
            cut = F.when((test["encoding"] == x.encoding) & (_band(test["length"]) == x.band), x["cut"]).otherwise(cut)
        return _bin(test["p"]) < cut

    kept = F.filter("runs", passes)
    whole = F.concat("base", F.transform(kept, lambda r: r["span"]))
    ordered = F.array_sort(F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return rows.select("doc_id", ordered.alias("spans"))


def named(spans_: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
