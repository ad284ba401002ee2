"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its lines that have a word.  From each line on, the lines up to ``gram`` words form a
gram; in every stretch of ``window`` words the gram with the smallest hash is selected as a fingerprint, so a run of lines
of ``gram + window - 1`` words or more that occurs twice shares fingerprints, which overlap if a gram is longer than a
window: the run is found whole even if parts of it first occurred in different places.  Equal fingerprints are joined by position
with their first occurrence, in order of document and line, and the match is extended line by line both ways.  Where
the extended run has ``least`` words or more, it is a later repetition, and its lines (with blank lines between them) go.

A fingerprint carries the lines around it, up to ``reach`` words on either side.  As fingerprints of a run lie at most
a window apart, what one cannot reach another does.

Defined cases: a NULL text stays NULL; a text without repeated runs stays as it is, to the byte; one whose lines all go
becomes empty; documents are ordered by id, then by hash of the text, NULL ids last; repeated rows of equal id and text
are one document, treated alike; columns other than id and text are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrew.llm.tables import packed, stored, unpacked

GRAM = 30
WINDOW = 11
LEAST = 30
REACH = 60


def _hash(text: Column) -> Column:
    """60 bits of the md5 sum, as other engines have it, too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def document_key(id_col: str, text_col: str) -> Column:
    """Orders documents and tells them apart: id (NULL last), then the text's hash."""
    key = F.col(id_col)
    return F.struct(key.isNull().alias("no_id"), key.alias("id"), _hash(F.col(text_col).cast("binary")).alias("text"))


def _once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, _text): one row of every document with a text; as a rule no row is repeated, and texts are not shuffled."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(document_key(id_col, text_col).alias("doc"), F.col(text_col).alias("_text"))
    again = stored(rows.groupBy(F.col("doc").alias("again")).count().filter("count > 1").select("again"), "repeated-rows")
    if again.isEmpty():
        return rows
    same = F.col("doc") == F.col("again")
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc"]))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, gram: int, window: int, reach: int) -> DataFrame:
    """(doc, line, n_lines, print, before, after, ...) for every selected gram, with its surroundings."""
    # One row per line with a word: position among these lines, first and last words, hash.
    lines = F.filter(
        F.transform(F.split("_text", "\n"), lambda line, k: F.struct(k.alias("at"), line.alias("line"))),
        lambda x: F.regexp_like(x["line"], F.lit(r"[^\x20\x09-\x0D]")),
    )
    rows = (
        _once(docs, id_col, text_col)
        .select("doc", F.posexplode(lines).alias("line", "x"))
        .select(
            "doc",
            "line",
            F.col("x.at").alias("at"),
            F.struct(
                _hash(F.col("x.line").cast("binary")).alias("h"),
                F.regexp_count("x.line", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"),
            ).alias("own"),
        )
    )
    by_doc = Window.partitionBy("doc").orderBy("line")
    at_word = rows.withColumn(
        "start", F.sum("own.n").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own.n")
    )
    by_word = Window.partitionBy("doc").orderBy("start")
    lines_of_gram = F.collect_list("own").over(by_word.rangeBetween(Window.currentRow, gram - 1))
    grams = at_word.withColumn("lines", lines_of_gram).withColumn(
        "print",
        F.when(
            F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]) >= gram,
            _hash(F.array_join(F.transform("lines", lambda x: x["h"].cast("string")), ",").cast("binary")),
        ),
    )
    least = F.min(F.when(F.col("print").isNotNull(), F.struct("print", "line"))).over(
        by_word.rangeBetween(Window.currentRow, window - 1)
    )
    marked = grams.withColumn("least", least["line"])
    selected = F.array_contains(
        F.collect_list("least").over(by_word.rangeBetween(-(window - 1), Window.currentRow)), F.col("line")
    )
    around = marked.withColumns(
        {
            "selected": selected,
            "before": F.collect_list("own").over(by_word.rangeBetween(-reach, -1)),
            "after": F.collect_list("own").over(by_word.rangeBetween(1, gram + reach)),
        }
    )
    return around.filter("selected").select(
        "doc",
        "line",
        "print",
        F.size("lines").alias("n_lines"),
        F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]).alias("n_words"),
        "before",
        F.slice("after", F.size("lines"), F.greatest(F.lit(0), F.size("after") - F.size("lines") + 1)).alias("after"),
    )


def _agreeing(a: Column, b: Column, backwards: bool) -> Column:
    """How many lines agree from the near end of two lists on."""
    most = F.least(F.size(a), F.size(b))
    at = lambda side, k: F.get(side, (F.size(side) - 1 - k) if backwards else k)["h"]
    steps = F.filter(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda k: ~at(a, k).eqNullSafe(at(b, k)))
    return F.when(most > 0, F.coalesce(F.array_min(steps), most)).otherwise(0)


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, least: int = LEAST, reach: int = REACH
) -> DataFrame:
    """(doc, first, last): runs of lines, by position among those with a word, that repeat an earlier run."""
    prints = stored(fingerprints(docs, id_col, text_col, gram, window, reach), "line-fingerprints")
    # Fingerprints that occur once, which are most, end here; counts are added up before the shuffle.
    firsts = stored(
        prints.groupBy("print")
        .agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("print").alias("key"), "first"),
        "first-positions",
    )
    place = F.struct("doc", "line")
    meeting = prints.join(firsts, F.col("print") == F.col("key"))
    sources = stored(
        meeting.filter(place == F.col("first")).select("key", F.col("before").alias("s_before"), F.col("after").alias("s_after")).dropDuplicates(["key"]),
        "first-surroundings",
    )
    later = stored(meeting.filter(place > F.col("first")).drop("key", "first"), "later-positions")
    matched = later.join(sources, F.col("print") == F.col("key")).select(
        "doc",
        "line",
        "n_lines",
        "n_words",
        "before",
        "after",
        _agreeing(F.col("before"), F.col("s_before"), True).alias("left"),
        _agreeing(F.col("after"), F.col("s_after"), False).alias("right"),
    )
    words = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["n"])
    left = F.slice("before", F.size("before") - F.col("left") + 1, F.col("left"))
    right = F.slice("after", 1, F.col("right"))
    return matched.filter(F.col("n_words") + words(left) + words(right) >= least).select(
        "doc", (F.col("line") - F.col("left")).alias("first"), (F.col("line") + F.col("n_lines") - 1 + F.col("right")).alias("last")
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """(row, text, n_lines, n_removed): every document as a struct, its text without later repeated runs, the number of
    its lines with a word, and how many of them went."""
    runs = repeated_runs(docs, id_col, text_col, **settings)
    gone = (
        runs.groupBy("doc")
        .agg(F.collect_set(F.struct("first", "last")).alias("runs"))
        .select(
            F.col("doc").alias("of_doc"),
            F.sort_array(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))).alias("gone"),
        )
    )
    rows = packed(docs, doc=document_key(id_col, text_col), lines=F.split(text_col, "\n")).join(
        gone, F.col("doc") == F.col("of_doc"), "left"
    )
    has_word = lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))
    # Positions, among all lines, of those with a word.  Lines that go are given by position among the latter; blank
    # lines between two neighbours that go, go with them.
    worded = rows.withColumn(
        "worded", F.filter(F.transform("lines", lambda line, k: F.when(has_word(line), k)), lambda k: k.isNotNull())
    )
    gone_at = F.transform("gone", lambda k: F.get("worded", k))
    blanks = F.flatten(
        F.transform(
            F.array_intersect("gone", F.transform("gone", lambda k: k - 1)),
            lambda k: F.sequence(F.get("worded", k), F.get("worded", k + 1)),
        )
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.array_union(gone_at, blanks))
    text = F.array_join(F.transform(kept, lambda k: F.get("lines", k)), "\n")
    return worded.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(text).alias("text"),
        F.coalesce(F.size("worded"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The documents, all columns, with later repeated runs of lines taken out of the text."""
    return unpacked(cleaned(docs, id_col, text_col, **settings), docs.columns, **{text_col: F.col("text")})
