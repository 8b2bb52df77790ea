"""URL filter: host and path rules, then a weighted vocabulary over the whole url.

Rules come first: a rule fits its host and every subdomain if the path starts
with the rule's path; the longest rule wins.  Other urls are judged by an
Aho-Corasick automaton that finds the terms of a vocabulary: strict and soft ones,
each with a weight, given or loaded from a file.  A hit counts only between
boundaries (no ASCII letter or digit on either side).  A url is rejected by one
strict term or by ``soft_limit`` distinct soft ones; its score is the sum of the
weights of the distinct terms that it holds.

Null urls and urls without ``://`` have an empty host and path, no rule, and are
judged by the vocabulary alone (null: no hits).  Repeated rows stay repeated;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STRICT = ("spam-farm", "cheap-pills", "casino", "porn", "xxx", "viagra", "escort", "sexcam", "torrentz", "warez")
SOFT = ("spam", "pills", "cheap", "free-money", "bonus", "jackpot", "betting", "adult", "nude", "crack", "keygen", "loan", "replica", "miracle")
STRICT_WEIGHT, SOFT_WEIGHT = 2, 1


class Term(NamedTuple):
    """A term in small letters, whether one hit of it rejects, and its weight."""

    text: str
    strict: bool
    weight: int


VOCABULARY = (*(Term(t, True, STRICT_WEIGHT) for t in STRICT), *(Term(t, False, SOFT_WEIGHT) for t in SOFT))


def load_vocabulary(spark: SparkSession, path: str) -> tuple[Term, ...]:
    """Terms from a text file: a line each, `strict` or `soft`, the weight and the term, with tabs between; empty lines and those with # are left out."""
    out = []
    for row in spark.read.text(path).collect():  # a vocabulary has to fit in every task
        line = row[0].strip()
        if line and not line.startswith("#"):
            kind, weight, term = line.split("\t", 2)
            if kind not in ("strict", "soft"):
                raise ValueError(f"vocabulary line {line!r}: neither strict nor soft")
            out.append(Term(term.strip().lower(), kind == "strict", int(weight)))
    return tuple(out)


def split_url(url):
    """(host, path) columns; both empty where the url is null or has no ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(after, r"(?s)^[^/?#]*", 0)), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def vocabulary_hits(df: DataFrame, url: str = "url", vocabulary=VOCABULARY) -> DataFrame:
    """df with strict_hits, soft_hits (distinct terms), score and terms (sorted, comma-joined)."""
    added = {"strict_hits": "int", "soft_hits": "int", "score": "int", "terms": "string"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} {k}" for n, k in added.items()]

    def scan(batches) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        words = ahocorasick.Automaton()
        for term in vocabulary:
            words.add_word(term.text, tuple(term))
        words.make_automaton()
        fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        plain = set("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index(url)).to_pylist():
                text = (text or "").translate(fold)
                hits = set()
                for end, (term, strict, weight) in words.iter(text) if len(words) else ():
                    start = end - len(term) + 1
                    if (start == 0 or text[start - 1] not in plain) and (end + 1 == len(text) or text[end + 1] not in plain):
                        hits.add((term, strict, weight))
                strict_hits = sum(strict for _, strict, _ in hits)
                found.append((strict_hits, len(hits) - strict_hits, sum(weight for *_, weight in hits), ",".join(sorted(t for t, *_ in hits))))
            columns = [pa.array([x[i] for x in found], pa.int32() if kind == "int" else pa.string()) for i, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return df.mapInArrow(scan, ", ".join(fields))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary=VOCABULARY, soft_limit: int = 2) -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits, score, terms."""
    host, path = split_url(F.col("__url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(id_col), F.col(url_col).alias("__url"))
    out = vocabulary_hits(base, "__url", vocabulary).withColumns({"host": host, "path": path})
    by_terms = F.when((F.col("strict_hits") >= 1) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "strict_hits", "soft_hits", "score", "terms")


def op5_url_filter(spark, sf_dir):
    from .common import table

    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fold = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"CASE WHEN regexp_matches(folded, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    terms = " ".join(f"|| CASE WHEN regexp_matches(folded, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN ',{t}' ELSE '' END" for t in sorted(STRICT + SOFT))
    return f"""
WITH a AS (SELECT page_id, {fold} AS folded, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
b AS (SELECT page_id, folded,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest)} END AS rule,
        CASE {" ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in longest)} END AS said,
        CAST({" + ".join(map(hit, STRICT))} AS INTEGER) AS strict_hits, CAST({" + ".join(map(hit, SOFT))} AS INTEGER) AS soft_hits,
        '' {terms} AS found FROM b)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, CAST({STRICT_WEIGHT} * strict_hits + {SOFT_WEIGHT} * soft_hits AS INTEGER) AS score, substr(found, 2) AS terms FROM c"""


OP5_SQL = _sql()
