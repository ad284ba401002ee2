"""Language identification by fusing several pieces of evidence about a page.

The likelihood of the text comes from byte trigrams counted over all documents of known language.  What pages declare
in their markup, and the priors of their hosts, come from grouped aggregation over all pages: posteriors of the text
alone are summed per declared language, and per level of the address (everything, suffix, domain, host), and each
level is smoothed towards the one above it.  A page's own share is taken out of its address's sums before they judge it.

Defined cases: a page without text is judged by markup and address; NULL or odd urls share one empty host; an unknown
or missing declaration is a value of its own; equal posteriors go to the alphabetically first language; repeated rows
are each judged; without documents of known language every page is 'und' with probability 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.docstats import texts_of
from tidecrew.llm.tables import stored
from tidecrew.llm.words import chunks

BUCKETS = 1 << 14
# Language codes told apart at most; documents of more codes raise an error.
LANGUAGES = 512
# A text counts as so many independent trigrams at most, since neighbouring trigrams repeat each other's evidence.
EVIDENCE = 200.0
# Pages a level above is worth when smoothing the one below.
SMOOTHING = 5.0
_HIDDEN = re.compile(rb"<(script|style|head|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>?", re.S | re.I)
_ENTITY = re.compile(rb"&#?\w{1,31};?")


def trigram_buckets(data: bytes) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text, with ASCII letters in lower case and runs of other ASCII as a space."""
    clean = re.sub(rb"[^a-z\x80-\xff]+", b" ", data.lower())
    b = np.frombuffer(b" " + clean.strip() + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 5:
        return np.zeros(0, dtype=np.int64)
    value = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((value * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


def visible(html: bytes) -> bytes:
    """The text of a page between its tags."""
    return _ENTITY.sub(b" ", _HIDDEN.sub(b" ", html))


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and the counts of every trigram bucket in each, over all documents of known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            at = 0
            for part in chunks(texts_of(batch.column(0))):
                own: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[at : at + len(part)], part, strict=True):
                    own.setdefault(lang, []).append(text)
                at += len(part)
                for lang, texts in own.items():
                    counts = np.bincount(trigram_buckets(b"  ".join(texts)), minlength=BUCKETS)
                    sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"]
            )

    known = docs.filter(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    rows = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = stored(rows, "trigrams")
    langs = [row["lang"] for row in found.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} language codes")
    place = {lang: k for k, lang in enumerate(langs)}
    table = np.zeros((len(langs), BUCKETS))
    got = found.toArrow().to_pydict()
    table[[place[lang] for lang in got["lang"]], got["bucket"]] = got["n"]
    return langs, table


def log_likelihoods(table: np.ndarray) -> np.ndarray:
    """Log-probability of a bucket in every language, as buckets x languages."""
    smooth = table + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).T


def text_evidence(pages: DataFrame, logs: np.ndarray, html_col: str) -> DataFrame:
    """The pages with ``evidence``: tempered log-likelihoods of their text, one for each language."""
    held = pages.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for batch in batches:
            rows = []
            for html in texts_of(batch.column(0)):
                buckets = trigram_buckets(visible(html))
                total = logs[buckets].sum(axis=0)
                total = total * (EVIDENCE / (EVIDENCE + len(buckets)))
                rows.append((total - total.max()).tolist() if len(total) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*names, "evidence"])

    names = [name for name in pages.columns if name != html_col]
    kinds = [f"{name} {pages.schema[name].dataType.simpleString()}" for name in names]
    return pages.select(html_col, *names).mapInArrow(run, ", ".join([*kinds, "evidence array<double>"]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _shares(logs: Column) -> Column:
    """Probabilities from log weights."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda x: x / _total(weights))


def _sums(rows: DataFrame, key: str, languages: int) -> DataFrame:
    """(key, sums): the text posteriors of all rows of a key, added up language by language.  A plain sum for each
    language and task is all that is shuffled, so a host with a third of all pages is no burden."""
    added = rows.groupBy(key).agg(*[F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(languages)])
    return stored(added.select(key, F.array(*[f"s{k}" for k in range(languages)]).alias(f"{key}_sums")), f"sums-{key}")


def _without(sums: Column, own: Column) -> Column:
    return F.zip_with(sums, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))


def _smoothed(sums: Column, above: Column) -> Column:
    return F.zip_with(sums, above, lambda n, p: (n + SMOOTHING * p) / (_total(sums) + SMOOTHING))


def identified(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(id, url, host, declared, text_language, language, probability) of every page."""
    langs, table = trigram_counts(docs, lang_col, text_col)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", 1))
    named = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), declared.alias("declared")
    )
    if not langs:
        return named.select(
            F.col("id").alias(id_col), "url", "host", "declared", F.lit("und").alias("text_language"), F.lit("und").alias("language"), F.lit(0.0).alias("probability")
        )
    n = len(langs)
    codes = F.array(*[F.lit(lang) for lang in langs])
    seen = stored(
        text_evidence(named, log_likelihoods(table), "html").withColumns(
            {
                "own": _shares(F.col("evidence")),
                "suffix": F.element_at(F.split("host", r"\."), -1),
                "domain": F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.lit(1), F.size(F.split("host", r"\.")) - 1), 2), "."),
            }
        ),
        "page-evidence",
    )
    whole = seen.agg(*[F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(n)]).first()
    everywhere = F.array(*[F.lit(float(s or 0.0)) for s in whole])
    level = _smoothed(_without(everywhere, F.col("own")), F.array(*[F.lit(1.0 / n)] * n))
    joined = seen
    for key in ("suffix", "domain", "host", "declared"):
        joined = joined.join(_sums(seen, key, n).withColumnRenamed(key, f"{key}_key"), F.col(key) == F.col(f"{key}_key"), "left")
    priors = joined.withColumn("prior", level)
    for key in ("suffix", "domain", "host"):
        priors = priors.withColumn("prior", _smoothed(_without(F.col(f"{key}_sums"), F.col("own")), F.col("prior")))
    # How often a language's pages declare this; unseen pairs count as a fraction of a page.
    says = F.zip_with(
        _without(F.col("declared_sums"), F.col("own")), _without(everywhere, F.col("own")), lambda a, b: F.log((a + 0.1) / (b + 1.0))
    )
    fused = F.zip_with(F.zip_with("evidence", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), says, lambda a, b: a + b)
    best = lambda shares: codes[(F.array_position(shares, F.array_max(shares)) - 1).cast("int")]
    return priors.withColumn("posterior", _shares(fused)).select(
        F.col("id").alias(id_col),
        "url",
        "host",
        "declared",
        best(F.col("own")).alias("text_language"),
        best(F.col("posterior")).alias("language"),
        F.array_max("posterior").alias("probability"),
    )
