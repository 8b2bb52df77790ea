"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

Base spans come from three patterns (assignments, access keys, hex runs).  Other
candidates are runs of at least ``LEAST_CHARS`` characters of the base64 alphabets
that hold a letter and a digit, carry ``least_bits`` bits and touch no base span;
shorter tokens can't be told from words by their letters and are left to the
patterns.  Each candidate's encoding is inferred (hex, base32, letters and digits,
base64), its characters become numbers of that alphabet, and three tests ask whether
they are uniform and independent: chi-squared over the alphabet, runs about the
middle, and serial correlation.  The least of the three p-values p counts as
1 - (1 - p) ** 3, which is uniform for random tokens.

Candidates above a threshold are reported as secrets.  What the threshold controls is
the share of false ones among those reported: p-values of secrets are uniform, those
of names and words stand close to 0, so of the tokens above ``TRUSTED`` there are
1 - TRUSTED of all secrets, and what a lower threshold t brings beyond (1 - t) times
that number is false.  The least t is taken at which this share is at most ``rate``;
it is at most TRUSTED.  (Words that look random to all three tests count as secrets:
nothing tells them apart.)  Long tokens betray words far better than short ones, so
each doubling of the length has a threshold of its own, from a histogram of p-values
over all documents with a fixed number of cells; one row for each filled cell reaches
the driver.

All of it is DataFrame functions, and linear in the text: running sums and maxima are
taken in blocks, and what is used for each character is worked out once.  Spans are
code points, end exclusive.  Null and empty texts have no spans; very long texts,
tokens and numbers of matches are a matter of memory for one text.  Repeated rows
stay repeated; an empty table gives an empty result; extra columns are carried only
when asked for in ``keep``.
"""

from __future__ import annotations

from math import ceil, log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Fixed values of the contract. ACCESS and HEX are the contract's pattern and least length in one.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_CHARS, RATE, LEAST_BITS, TRUSTED = 20, 0.05, 80, 0.05
#: Stands for the characters of a base span; what a text has of it counts as white space.
MASK = "\ue000"
TOKEN = rf"(?<![A-Za-z0-9+/_={MASK}-])[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}+(?!{MASK})"
#: Cells of the histogram: a decade of p-values has 20, the last holds all below 1e-12.
CELL, CELLS = 0.05, 240
#: Elements that one running sum goes through, and characters that a text is cut into.
BLOCK, PIECE = 256, 4096
_SPANS = "array<struct<s:int,e:int,p:double>>"
_DIGITS, _CAPITALS, _SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _none():
    return F.array().cast(_SPANS)


def _matches(text, some, pattern: str, group: int = 0):
    """(gaps before and after matches, matches, a group of each) of texts that may match; empty arrays for others.

    The arrays are columns of their own, so that no pattern is matched again for each element."""
    none = F.array().cast("array<string>")
    every = lambda g: F.when(some, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(g + 1))).otherwise(none)
    return F.when(some, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>")), every(0), every(group)


def _let(value, body):
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values, op, zero):
    """For each element the op of all before it (zero for the first); op is associative."""
    def blocks(items):
        return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda i: F.slice(items, i, BLOCK))

    def scan(items, first):
        grown = F.aggregate(items, F.array(first), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))
        return F.slice(grown, 1, F.size(items))

    def scanned(parts):
        totals = F.transform(parts, lambda b: F.aggregate(b, zero, lambda a, x: op(a, x)))
        return F.flatten(F.zip_with(parts, _let(totals, lambda t: scan(t, zero)), scan))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), scanned)).otherwise(F.slice(v, 1, 0)))


def _spans(gaps: str, found: str, tested: str, keep=None, p=None):
    """Spans of the matches that keep accepts, in order; keep and p see the tested group."""
    n = F.size(found)
    step = F.zip_with(F.slice(gaps, 1, n), F.transform(found, F.length), lambda g, m: g + m)
    ends = F.zip_with(_running(step, lambda a, b: a + b, F.lit(0)), step, lambda a, b: a + b)
    sized = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e")))
    every = F.zip_with(sized, tested, lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v")))
    kept = F.filter(every, lambda x: keep(x["v"])) if keep else every
    spans = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (p(x["v"]) if p else F.lit(1.0)).cast("double").alias("p")))
    return F.when(n > 0, spans.cast(_SPANS)).otherwise(_none())


def _masked(text, found: str, tested: str, keep, pattern: str):
    """text with the characters of the matches that keep accepts as MASK."""
    given = F.translate(text, MASK, " ")
    hidden = F.zip_with(found, tested, lambda m, v: F.when(keep(v), F.repeat(F.lit(MASK), F.length(m))).otherwise(m))
    pieces = F.zip_with(F.split(given, pattern, -1), hidden, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(given)


def upper_tail(z):
    """P(Z > z) of the standard normal, within 1.4e-4 and with the right decay."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def alphabet(token):
    """The inferred encoding's characters."""
    return (
        F.when(token.rlike("^[0-9a-f]+$"), F.lit(_DIGITS + _SMALL[:6]))
        .when(token.rlike("^[0-9A-F]+$"), F.lit(_DIGITS + _CAPITALS[:6]))
        .when(token.rlike("^[A-Z2-7]+$"), F.lit(_CAPITALS + "234567"))
        .when(token.rlike("^[a-z0-9]+$"), F.lit(_DIGITS + _SMALL))
        .when(token.rlike("^[A-Z0-9]+$"), F.lit(_DIGITS + _CAPITALS))
        .when(token.rlike("^[A-Za-z0-9]+$"), F.lit(_CAPITALS + _SMALL + _DIGITS))
        .when(token.rlike("[_-]"), F.lit(_CAPITALS + _SMALL + _DIGITS + "-_+/"))
        .otherwise(F.lit(_CAPITALS + _SMALL + _DIGITS + "+/"))
    )


def p_value(token):
    """The battery's p-value of a token under uniform and independent characters."""
    core = F.regexp_replace(token, "=+$", "")
    return _let(F.struct(core.alias("core"), alphabet(core).alias("letters")), _battery)


def _battery(a):
    core, letters = a["core"], a["letters"]
    size, n = F.length(letters).cast("double"), F.length(core).cast("double")
    half, middle = size / 2, (size - 1) / 2
    often = lambda i: (n - F.length(F.replace(core, F.substring(letters, i, F.lit(1)), F.lit("")))).cast("double")
    seen = F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0.0), lambda t, i: t + often(i) * often(i))
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial"), F.lit(0.0).alias("high"))
    yes = lambda test: F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))

    def step(s, v):
        some = s["last"] >= 0
        return F.struct(
            v.alias("last"), (s["runs"] + yes(some & ((v >= half) != (s["last"] >= half)))).alias("runs"),
            (s["serial"] + F.when(some, (s["last"] - middle) * (v - middle)).otherwise(F.lit(0.0))).alias("serial"), (s["high"] + yes(v >= half)).alias("high"),
        )

    values = F.transform(F.split(core, ""), lambda c: (F.position(c, letters) - 1).cast("double"))
    found = F.struct(F.aggregate(values, start, step).alias("x"), seen.alias("seen"))

    def combined(f):
        x = f["x"]
        p_chi = upper_tail((f["seen"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
        mean = 2 * x["high"] * (n - x["high"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * upper_tail(F.abs(x["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(F.lit(0.0))
        p_serial = 2 * upper_tail(F.abs(x["serial"]) / ((size * size - 1) / 12 * F.sqrt(n - 1)))
        return _let(F.least(F.lit(1.0), p_chi, p_runs, p_serial), lambda p: p * (3 - 3 * p + p * p))  # 1 - (1 - p) ** 3

    return _let(found, combined)


def bits(token):
    """Length of a token in bits of its inferred encoding."""
    core = F.regexp_replace(token, "=+$", "")
    return F.length(core) * F.log2(F.length(alphabet(core)).cast("double"))


def _size_class(n):
    """0 from LEAST_CHARS characters on, and one more for each doubling."""
    return F.floor(F.log2(n.cast("double") / LEAST_CHARS)).cast("int")


def _cell(p):
    return F.least(F.lit(CELLS), F.floor(-F.log10(F.greatest(p, F.lit(1e-18))) / CELL)).cast("int")


def thresholds(cells: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """For each size class the last cell that is reported, from the tokens in each (class, cell): the share of false ones is at most rate."""
    out, trusted = {}, ceil(-log10(TRUSTED) / CELL)
    for size in sorted({k for k, _ in cells}):
        sure = sum(cells.get((size, i), 0) for i in range(trusted)) / (1 - 10 ** (-trusted * CELL))
        taken, out[size] = 0, trusted - 1
        for i in range(CELLS):
            taken += cells.get((size, i), 0)
            if i >= trusted and taken - sure * (1 - 10 ** (-(i + 1) * CELL)) <= rate * taken:
                out[size] = i
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, least_bits: float = LEAST_BITS, keep: list[str] = ()) -> DataFrame:
    """id, assign, access, hex, random (arrays of s, e, p) and the columns in keep (as a struct `kept`)."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *kept)
    low = F.lower(text)
    some = {
        "assign": low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key"),
        "access": text.contains("AKIA"),
        "hex": text.rlike(HEX),
        "random": text.rlike(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS}}}"),
    }
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "random": (TOKEN, 0)}
    rows = rows.withColumns({f"__some_{k}": c for k, c in some.items()})

    def matched(rows: DataFrame, kinds, of) -> DataFrame:
        found = {k: _matches(of, F.col(f"__some_{k}"), *patterns[k]) for k in kinds}
        return rows.withColumns({f"__{n}_{k}": c for k, cs in found.items() for n, c in zip("gmv", cs, strict=True)})

    enough = lambda v: F.length(v) >= 8
    rows = matched(rows, KINDS[:3], text)
    rows = rows.withColumn("__masked", F.when(F.col("__some_random"), _masked(text, "__m_assign", "__v_assign", enough, ASSIGN)).otherwise(F.lit("")))
    rows = matched(rows, KINDS[3:], F.col("__masked"))
    # hex runs and access keys lie within one token
    free = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & ~t.rlike(HEX) & ~t.rlike(ACCESS) & (bits(t) >= least_bits)
    spans = lambda k, *a: _spans(f"__g_{k}", f"__m_{k}", f"__v_{k}", *a)
    rows = rows.withColumns({"assign": spans("assign", enough), "access": spans("access"), "hex": spans("hex"), "random": spans("random", free, p_value)})
    rows = save(rows.select("id", *KINDS, *(["kept"] if keep else [])), "secrets")
    size = lambda x: _size_class(x["e"] - x["s"])
    cand = rows.select(F.explode("random").alias("x")).groupBy(size(F.col("x")).alias("size"), _cell(F.col("x.p")).alias("cell")).agg(F.count("*").alias("n"))
    last = thresholds({(r["size"], r["cell"]): r["n"] for r in cand.collect()}, rate)
    limits = F.create_map(*[F.lit(v) for kv in last.items() for v in kv]) if last else F.create_map(F.lit(0), F.lit(0))
    return rows.withColumn("random", F.filter("random", lambda x: _cell(x["p"]) <= F.element_at(limits, size(x)))).withColumnRenamed("id", id_col)


def span_list(kinds) -> object:
    """All spans of the kinds by start, then kind as listed, as structs (s, k, e, name)."""
    def part(k):
        return F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e"), F.lit(k).alias("name")))

    return F.array_sort(F.concat(*map(part, kinds)))


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text, spans, mark: str = "[SECRET]"):
    """text with each maximal run of overlapping spans (sorted by their starts) replaced by mark."""
    def cut(parts, a, b):
        """Characters a to b of a text that is cut into pieces of PIECE characters."""
        of = lambda k: F.substring(F.element_at(parts, k + 1), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        places = F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int"))
        return F.when(b > a, F.array_join(F.transform(places, of), "")).otherwise(F.lit(""))

    def done(x):
        parts = x["parts"]
        before = _running(F.transform(x["spans"], lambda y: y["e"]), F.greatest, F.lit(0))
        out = F.zip_with(x["spans"], before, lambda y, at: F.when(y["s"] >= at, F.concat(cut(parts, at, y["s"]), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform(x["spans"], lambda y: y["e"]))
        return F.concat(F.array_join(out, ""), cut(parts, end, F.greatest(end, x["n"])))

    parts = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))
    return F.when(F.size(spans) > 0, _let(F.struct(parts.alias("parts"), spans.alias("spans"), F.length(text).alias("n")), done)).otherwise(text)


def op3_secret_scan(spark, sf_dir):
    from .common import table

    rows = find_secrets(table(spark, sf_dir, "documents"))
    base, every = span_list(KINDS[:3]), span_list(KINDS)
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
