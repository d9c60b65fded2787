"""Quality rules: counts of a text's words, lines and symbols, and its distance from its language.

Everything here is a DataFrame expression. A document's own figures come from its row alone; the references
come from one grouped sum over all documents, a row for each language.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import let, shielded, stored, words

# Frequent function words of the languages judged by word use.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "qui", "est"],
    "de": ["der", "die", "und", "den", "von", "das", "mit", "des", "auf", "ist", "im", "zu"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "por", "un", "una"],
}
# The characters of each class; what is in none counts as "other".
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
STOPS = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a text is far from its language.
MAX_CHARACTER_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.25
#: Words from which on a text's histograms are full enough to be held against them.
MIN_JUDGED_WORDS = 100
N_CLASSES = 7
N_COMMON = 13
#: Repeated windows up to which positions are looked up among them; beyond, windows are sorted with their positions.
FEW = 24


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit("[" + re.escape(chars) + "]")).cast("long")


def _repeated(w: Column) -> Column:
    """Words in three-word windows that the text holds twice or more, the first included."""

    def width(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), width)

        return let(pairs, same)

    def covered(hashes: Column) -> Column:
        def among(v: Column) -> Column:
            few = let(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(v, F.get(hashes, i))), width)
            return F.when(F.size(v) == 0, F.lit(0)).when(F.size(v) <= FEW, few).otherwise(by_sort(hashes))

        return let(let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j + 1)))), among)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, let(windows, covered)).otherwise(F.lit(0)).cast("long")


def _common(w: Column, lang: Column) -> Column:
    """How often each common word of the language occurs, and last how many other words there are."""
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def by_list(own: Column) -> Column:
        each = F.array(*[(F.size(w) - F.size(F.array_remove(w, F.get(own, F.lit(i))))).cast("long") for i in range(N_COMMON - 1)])
        return let(each, lambda c: F.concat(c, F.array(F.size(w) - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))))

    own = F.try_element_at(lists, F.coalesce(lang, F.lit("")))
    return F.when(own.isNotNull(), let(own, by_list))


def character_classes(text: Column, word_chars: Column, symbols: Column) -> Column:
    """Counts of upper case, digits, stops, symbols, white space, bytes beyond ASCII's one a character, and the rest."""
    own = F.array(_count(text, UPPER), _count(text, DIGITS), _count(text, STOPS), symbols, F.length(text) - word_chars, F.octet_length(text).cast("long") - F.length(text))
    return let(own, lambda c: F.concat(c, F.array(F.greatest(F.lit(0), F.length(text) - F.get(c, F.lit(0)) - F.get(c, F.lit(1)) - F.get(c, F.lit(2)) - F.get(c, F.lit(3)) - F.get(c, F.lit(4)) - F.get(c, F.lit(5))).cast("long"))))


def measures() -> Column:
    """A struct of the figures of ``text``, which may be null and counts as an empty one then."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def figures(w: Column) -> Column:
        chars = F.length(F.array_join(w, "")).cast("long")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), _count(text, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), _repeated(w).alias("n_repeat_words"),
            let(chars, lambda n: character_classes(text, n, _count(text, SYMBOLS))).alias("classes"), _common(w, F.col("lang")).alias("common"))

    return let(words(F.col("text")), figures)


def language_references(figures: DataFrame) -> DataFrame:
    """Sums of all documents' histograms: a row for each language, and one with null, which has those of all documents.

    figures: lang, classes, common.
    """
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON)]
    by_lang = stored(figures.groupBy("lang").agg(*sums))
    rows = F.struct(F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("classes"), F.array(*[F.coalesce(f"w{i}", F.lit(0)) for i in range(N_COMMON)]).alias("common"))
    every = by_lang.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(N_CLASSES)], *[F.lit(0).cast("long").alias(f"w{i}") for i in range(N_COMMON)])
    return stored(by_lang.where("lang is not null").select("lang", rows.alias("ref")).unionByName(every.select(F.lit(None).cast("string").alias("lang"), rows.alias("ref"))))


def with_reference(docs: DataFrame, references: DataFrame) -> DataFrame:
    """docs with _reference, that of the row's language. Spark broadcasts the references if their files are small."""
    return docs.join(references.select(F.col("lang").alias("_of"), F.col("ref").alias("_reference")), F.col("lang").eqNullSafe(F.col("_of")), "left").drop("_of")


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two arrays of counts; 0 if either is empty."""
    total = lambda x: F.aggregate(F.transform(x, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log(p / m)).otherwise(F.lit(0.0))

    def term(x: Column, y: Column, n: Column, k: Column) -> Column:
        p, q = x / n, y / k
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / (2 * math.log(2))

    def both(n: Column, k: Column) -> Column:
        return F.when((n > 0) & (k > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(a, b, lambda x, y: term(x, y, n, k)), F.lit(0.0), lambda s, v: s + v)))).otherwise(F.lit(0.0))

    return let(total(a), lambda n: let(total(b), lambda k: both(n, k)))


def judge(q: Column) -> Column:
    """From a struct of figures and the row's _reference: failed, character_distance, word_distance and kept."""
    own = F.col("_reference")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    characters = js_distance(q["classes"], own["classes"])
    words_ = F.when(q["common"].isNotNull(), js_distance(q["common"], own["common"])).otherwise(F.lit(0.0))
    found = F.struct(failed.alias("failed"), characters.alias("character_distance"), words_.alias("word_distance"))
    far = lambda v: (v["character_distance"] > MAX_CHARACTER_DISTANCE) | (v["word_distance"] > MAX_WORD_DISTANCE)
    kept = lambda v: ~v["failed"] & ~((q["n_words"] >= MIN_JUDGED_WORDS) & far(v))
    return let(found, lambda v: F.struct(v["failed"].alias("failed"), v["character_distance"].alias("character_distance"), v["word_distance"].alias("word_distance"), kept(v).alias("kept")))


def reports(docs: DataFrame) -> DataFrame:
    """The figures and the verdict of every document.

    docs: doc_id, text and lang, each of which may be null; further columns are not read. Null or empty text has no
    word and fails the length rule; long texts are judged whole; a language that is null is held against all documents;
    repeated rows count and return as often as they came; an empty table gives none. Texts below MIN_WORDS words fail by
    length; those below MIN_JUDGED_WORDS are not held against a distribution; a distance of just the limit is kept.
    """
    narrow = stored(docs.select("doc_id", "lang", measures().alias("_q")))
    references = language_references(narrow.select("lang", "_q.classes", "_q.common"))
    out = with_reference(narrow, references).withColumn("_v", judge(F.col("_q")))
    return out.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_v.failed").alias("base_failed"), "_v.kept", F.round("_v.character_distance", 9).alias("character_distance"), F.round("_v.word_distance", 9).alias("word_distance"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever they are named; see reports.

    Figures are worked out once, and written beside the rows: the references and the verdicts read them there.
    """
    inner, named = shielded(docs, "lang", "text")
    rows = stored(inner.withColumn("_q", measures()))
    references = language_references(rows.select("lang", "_q.classes", "_q.common"))
    return named(with_reference(rows, references).where(let(judge(F.col("_q")), lambda v: v["kept"])))


def _sql() -> str:
    space = "[^\\x20\\x09-\\x0D]"
    found = lambda chars: f"len(regexp_extract_all(t, '[{chars}]'))"
    own = [found("A-Z"), found("0-9"), found(".,;:!?''\"()\\-"), found("#*$%&|<>"), "length(t) - word_chars", "strlen(t) - length(t)"]
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in COMMON_WORDS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{space}+') AS w FROM documents),
b AS (SELECT r, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({found("#*$%&|<>")} AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS lines FROM d),
p AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM p WHERE n > 1) GROUP BY r),
c AS (SELECT r, lang, [{", ".join(own)}] AS c6, length(t) AS n, w, CASE lang {lists} END AS l FROM b),
h AS (
  SELECT r, lang, 'c' AS kind, unnest(range(1, 8)) AS k, unnest(list_append(c6, greatest(0, n - list_sum(c6)::BIGINT))) AS v FROM c
  UNION ALL SELECT r, lang, 'w', unnest(range(1, 14)), unnest(list_append(list_transform(l, lambda s: len(list_filter(w, lambda x: x = s))), len(w) - len(list_filter(w, lambda x: list_contains(l, x))))) FROM c WHERE l IS NOT NULL),
own AS (SELECT lang, kind, k, sum(v) AS v, sum(sum(v)) OVER (PARTITION BY lang, kind) AS n FROM h WHERE lang IS NOT NULL GROUP BY lang, kind, k),
every AS (SELECT kind, k, sum(v) AS v, sum(sum(v)) OVER (PARTITION BY kind) AS n FROM h WHERE kind = 'c' GROUP BY kind, k),
q AS (SELECT h.r, h.kind, h.v / nullif(sum(h.v) OVER (PARTITION BY h.r, h.kind), 0) AS p, coalesce(own.v / nullif(own.n, 0), every.v / nullif(every.n, 0)) AS q
  FROM h LEFT JOIN own ON own.lang = h.lang AND own.kind = h.kind AND own.k = h.k LEFT JOIN every ON every.kind = h.kind AND every.k = h.k),
j AS (SELECT r, kind, round(sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / (2 * ln(2))))), 9) AS js FROM q WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY r, kind),
o AS (SELECT b.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(jc.js, 0.0) AS character_distance, coalesce(jw.js, 0.0) AS word_distance
  FROM b LEFT JOIN rep USING (r) LEFT JOIN (SELECT * FROM j WHERE kind = 'c') jc USING (r) LEFT JOIN (SELECT * FROM j WHERE kind = 'w') jw USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {MIN_JUDGED_WORDS} AND (character_distance > {MAX_CHARACTER_DISTANCE} OR word_distance > {MAX_WORD_DISTANCE})) AS kept, character_distance, word_distance FROM f"""


SQL = _sql()
