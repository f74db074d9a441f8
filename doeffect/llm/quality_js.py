"""Quality rules, with a check of distribution divergence.

Base rules fail texts with few words or with many words in repeated windows.
The method compares two histograms of each text, of character classes and of
common words, with the references of its language (the mean histograms of
all texts of that language that pass the base rules and the length guard) by
Jensen-Shannon distance.  Texts shorter than the guard, and languages with
fewer than ``LEAST_TEXTS`` reference texts, are left to the base rules.

Everything about a text is worked out within its row; the references are a
small row of sums for each language, joined back: broadcast up to
``BROADCAST`` languages, by a join that Spark chooses beyond.  Nothing but
those sums is shuffled for the usual few languages, so no source or language
is a hot spot.

NULL text has no words and fails; a NULL language has no reference, whatever
other languages are called.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WINDOW = 8  # words of a repeated window
LEAST_BASE = 20  # words, base rule
MOST_REPEATED = 30  # per cent, base rule
LEAST_WORDS = 80  # length guard of the method
LEAST_TEXTS = 30  # of a reference
BROADCAST = 4096  # languages with a reference (about 1 KB each)
MOST_CHAR_DISTANCE = 0.25
MOST_WORD_DISTANCE = 0.55

# Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that it for on as with was be by are this "
    "der die das und ist ein nicht mit von zu den auf im "
    "le la les des et en un une que qui pour est dans "
    "el los las de y es no por con se su"
).split()
CLASSES = ["lower", "upper", "digit", "space", "other", "non_ascii"]
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the list."""
    none = F.lit(0).cast("long")

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(
            ordered,
            lambda o: F.filter(
                o,
                lambda e, i: F.coalesce(F.get(o, i - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get(o, i + 1)["h"] == e["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        # A window covers its words up to where the next one begins.
        own = _let(
            starts, lambda s: F.transform(s, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(s, i + 1), p + width) - p))
        )
        return F.aggregate(own, none, lambda acc, n: acc + n)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.when(
        F.size(words) >= width,
        _let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width)))),
    ).otherwise(F.array().cast("array<bigint>"))
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(none))


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row, the base counts and both histograms (``chars``, ``common``: counts)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", f"{SPACE}+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    text = F.col("text")
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length(text).cast("long").alias("n_chars"),
        _length_without(text, "[^a-z]+").cast("long").alias("lower"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("upper"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("digit"),
        (F.length(text) - _length_without(text, "[^\\x00-\\x7F]+")).cast("long").alias("non_ascii"),
        F.filter("words", lambda w: w.isin(COMMON)).alias("found"),
    )
    rows = rows.withColumn("space", F.col("n_chars") - F.col("word_chars"))
    rows = rows.withColumn("other", F.col("word_chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("non_ascii"))
    # Counts of the distinct ones first, then in the order of the list.
    kinds = F.transform(F.array_distinct("found"), lambda w: F.struct(w, F.size(F.filter("found", lambda x: x == w))))
    counts = _let(
        F.map_from_entries(kinds), lambda m: F.transform(F.array(*[F.lit(w) for w in COMMON]), lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0)))
    )
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < LEAST_BASE) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.array(*CLASSES).alias("chars"),
        F.concat(counts, F.array((F.col("n_words") - F.size("found")).cast("int"))).cast("array<bigint>").alias("common"),
    )


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms, 0 to 1."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2), F.lit(0.0), lambda acc, x: acc + x)
    return F.round(F.sqrt(F.greatest(total, F.lit(0.0))), 6)


def references(rows: DataFrame) -> DataFrame:
    """``ref_lang, ref_chars, ref_common``: the mean histograms of each language."""
    n, m = len(CLASSES), len(COMMON) + 1
    return (
        rows.where(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS) & F.col("lang").isNotNull())
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            *[F.avg(F.col("p_chars")[i]).alias(f"c{i}") for i in range(n)],
            *[F.avg(F.col("p_common")[i]).alias(f"w{i}") for i in range(m)],
        )
        .where(F.col("texts") >= LEAST_TEXTS)
        .select(
            F.col("lang").alias("ref_lang"),
            F.array(*[f"c{i}" for i in range(n)]).alias("ref_chars"),
            F.array(*[f"w{i}" for i in range(m)]).alias("ref_common"),
        )
    )


def judge(docs: DataFrame, **columns) -> DataFrame:
    """Base counts of every row, ``base_failed``, both distances (NULL if not compared) and ``kept``."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = features(docs, **columns).checkpoint()
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda acc, c: acc + c)
    rows = rows.withColumns({"p_chars": _share(F.col("chars"), total), "p_common": _share(F.col("common"), F.col("n_words"))})
    means = references(rows).checkpoint()
    few = means.limit(BROADCAST + 1).count() <= BROADCAST
    rows = rows.join(F.broadcast(means) if few else means, F.col("lang") == F.col("ref_lang"), "left")
    compared = (F.col("n_words") >= LEAST_WORDS) & F.col("ref_lang").isNotNull()
    rows = rows.withColumns(
        {
            "char_distance": F.when(compared, distance(F.col("p_chars"), F.col("ref_chars"))),
            "word_distance": F.when(compared, distance(F.col("p_common"), F.col("ref_common"))),
        }
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        "char_distance",
        "word_distance",
    )


def oracle_sql() -> str:
    """The same in DuckDB, over the table ``documents``."""
    m = len(COMMON) + 1

    def js(p, q):
        def part(a, b):
            return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"

        terms = f"list_transform(range(1, len({p}) + 1), lambda i: ({part(p + '[i]', q + '[i]')} + {part(q + '[i]', p + '[i]')}) / 2)"
        return f"round(sqrt(greatest(list_sum({terms}), 0.0)), 6)"

    counts = ", ".join(f"len(list_filter(words, lambda w: w = '{w}'))" for w in COMMON)
    found = " + ".join(f"common[{i + 1}]" for i in range(len(COMMON)))
    avg_c = ", ".join(f"avg(p_chars[{i + 1}])" for i in range(len(CLASSES)))
    avg_w = ", ".join(f"avg(p_common[{i + 1}])" for i in range(m))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT row, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS run
  FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
repeated AS (SELECT row, count(DISTINCT w) AS n FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS w FROM twice) GROUP BY row),
counted AS (
  SELECT s.row, doc_id, lang, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(text) AS n_chars,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS non_ascii,
    [{counts}] AS common
  FROM split s LEFT JOIN repeated r USING (row)),
rows AS (
  SELECT *, n_words < {LEAST_BASE} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    list_transform([lower, upper, digit, n_chars - word_chars, word_chars - lower - upper - digit - non_ascii, non_ascii],
      lambda c: c / greatest(n_chars, 1)::DOUBLE) AS p_chars,
    list_transform(list_append(common, n_words - ({found})), lambda c: c / greatest(n_words, 1)::DOUBLE) AS p_common
  FROM counted),
reference AS (
  SELECT lang, [{avg_c}] AS q_chars, [{avg_w}] AS q_common FROM rows
  WHERE NOT base_failed AND n_words >= {LEAST_WORDS} AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_TEXTS}),
compared AS (
  SELECT r.*, CASE WHEN q.lang IS NOT NULL THEN {js('p_chars', 'q_chars')} END AS char_distance,
    CASE WHEN q.lang IS NOT NULL THEN {js('p_common', 'q_common')} END AS word_distance
  FROM rows r LEFT JOIN reference q ON r.lang = q.lang AND r.n_words >= {LEAST_WORDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {MOST_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MOST_WORD_DISTANCE} AS kept,
  char_distance, word_distance
FROM compared
"""
