"""Quality rules: repetition within a text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut

#: A line goes if more documents of its host than both limits hold it.
LINE_DOCS, LINE_SHARE = 50, 0.02
#: A document goes if fewer than MIN_WORDS or less than KEEP_SHARE of its words remain.
MIN_WORDS, KEEP_SHARE = 50, 0.5
#: Bits of a packed number that hold a word's place in its text.
PLACE_BITS = 28


def _steps() -> dict[str, str]:
    """The count of words in 3-word windows found twice or more, step by step as columns; lambdas see the columns before.

    Each window becomes one long, its hash above and its place below; after sorting,
    windows with equal hashes are neighbours, and only these go on. If the words of any two
    neighbours differ under one hash, the text's windows are sorted anew by their words.
    Where repeated windows begin, ascending, tells how many words they cover.
    """
    hashed = lambda x: f"shiftrightunsigned({x}, {PLACE_BITS})"
    low = f"(shiftleft(1L, {PLACE_BITS}) - 1L)"
    word = lambda x, k: f"get(words, int({x} & {low}) + {k})"
    differ = " OR ".join(f"{word('x', k)} <> {word('get(near, i - 1)', k)}" for k in range(3))
    windows = "sort_array(transform(sequence(0, size(words) - 3), i -> struct(get(words, i) AS a, get(words, i + 1) AS b, get(words, i + 2) AS c, i AS at)))"
    equal = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in "abc")
    return {
        "packed": f"if(size(words) >= 3, sort_array(transform(sequence(0, size(words) - 3), i -> (xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)) & ~{low}) | i)), array())",
        "near": f"filter(packed, (x, i) -> (i > 0 AND {hashed('x')} = {hashed('get(packed, i - 1)')}) OR (i + 1 < size(packed) AND {hashed('x')} = {hashed('get(packed, i + 1)')}))",
        "mixed": f"exists(transform(near, (x, i) -> i > 0 AND {hashed('x')} = {hashed('get(near, i - 1)')} AND ({differ})), x -> x)",
        "exact": f"if(mixed, {windows}, array())",
        "places": f"if(mixed, sort_array(transform(filter(exact, (x, i) -> (i > 0 AND {equal('x', 'get(exact, i - 1)')}) OR (i + 1 < size(exact) AND {equal('x', 'get(exact, i + 1)')})), x -> bigint(x.at))), sort_array(transform(near, x -> x & {low})))",
        "n_repeat_words": "if(size(places) > 0, 3L + aggregate(if(size(places) > 1, sequence(2, size(places)), array()), 0L, (a, i) -> a + least(3L, get(places, i - 1) - get(places, i - 2))), 0L)",
    }


def measures(documents: DataFrame) -> DataFrame:
    """A slim row per document: its word, symbol and repetition counts, and the lines it holds, hashed, each once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    base = (
        documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))
        .withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
        .withColumn("lines", spread)
        # Lines are normalised as their words, lower-cased, joined by one space.
        .withColumn("line", F.transform("lines", lambda x: F.lower(F.trim(F.regexp_replace(x, SPACES, " ")))))
        .withColumn("line", F.transform("line", lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n"))))
    )
    for name, step in _steps().items():
        base = base.withColumn(name, F.expr(step))
    return base.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "line",
    )


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """The lines above both limits: host, line. Documents count once per line; partial sums leave each task first."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = rows.select("host", F.explode(F.array_distinct(F.col("line.line"))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    return often.join(hosts, "host").where(F.col("docs") > line_share * F.col("host_docs")).select("host", "line")


def quality_rules(documents: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_words: int = MIN_WORDS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Judge every document by its own text and by the lines it shares with others of its host (``source``).

    A null or empty text has no words and fails the base rules; a null host is a host
    of its own, named ''. Every row counts as a document of its own, repeated rows too.
    Extra columns are ignored; an empty table gives an empty result.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_line_words (words in lines that were removed) and kept.
    """
    rows = cut(measures(documents))
    often = cut(frequent_lines(rows, line_docs, line_share))
    each = rows.select("row", "host", F.explode("line").alias("at")).select("row", "host", "at.line", "at.n")
    # A line that a third of all documents hold is dealt anew by AQE: both sides are exchanged for this join alone.
    gone = each.join(often, ["host", "line"]).groupBy("row").agg(F.sum("n").cast("long").alias("n_line_words"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (F.col("n_line_words") > 0) & ((left < min_words) | (left < keep_share * F.col("n_words")))
    return (
        rows.drop("line", "host")
        .join(gone, "row", "left")
        .withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & ~depleted)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")
    )
