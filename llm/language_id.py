"""Language identification by compression with per-language zstandard raw-content dictionaries.

A bounded sample of labelled texts becomes one raw-content dictionary for each language. A text is cut into
blocks, each block is compressed with every dictionary, and the language whose dictionary gives the fewest
bytes in all is chosen. The score is how much smaller that is than the next language's; a document is
rejected if the score is narrow or if it has no letter.

* A null or empty text, or one without a letter: ``und``, score 0, rejected.
* Languages that give equally many bytes: the one with more labelled texts, then the first by name; score 0,
  rejected.
* No labelled text at all: every document is ``und``.
* Repeated rows get equal results; null ids and null labels are kept out of nothing but the learning.
* With more than ``MOST_LANGUAGES`` labels, those with the most labelled texts are learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.tables import texts

UNKNOWN = "und"
#: Sampled texts of a language, and the most characters of each that its dictionary takes.
SAMPLES = 256
SAMPLE_CHARS = 1024
#: Languages that are learned: every task holds their dictionaries, of 256 KB each.
MOST_LANGUAGES = 128
#: Characters compressed at a time, so that the dictionary counts throughout a long text.
BLOCK_CHARS = 4096
#: A lead below this share of the compressed bytes is narrow.
NARROW = 0.005
#: Every text is compressed at the first level; where its lead is below UNSURE, at the second as well.
LEVELS = (6, 12)
UNSURE = 0.08


def learn(docs: DataFrame, may_learn: Column, id_col="doc_id", text_col="text", lang_col="lang") -> dict[str, bytes]:
    """Dictionary content by language, the language with most labelled texts first.

    The sample is one text for each of ``SAMPLES`` buckets of the text's hash, the one with the least hash:
    a minimum that every task takes of its own rows first. Its size is bounded by ``SAMPLES * SAMPLE_CHARS``
    characters a language, whatever the input.
    """
    known = docs.filter(may_learn).select(
        F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text")
    )
    labels = known.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count()
    labels = [r.lang for r in labels.orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    known = known.filter(F.col("lang").isin(labels))
    # A text longer than the sample is taken from a place that its hash decides.
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    hashed = known.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    rows = (
        hashed.withColumn("text", F.substring("text", F.pmod("h", spare).cast("int") + 1, F.lit(SAMPLE_CHARS)))
        .groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("bucket"))
        .agg(F.min_by("text", F.struct("h", "text")).alias("text"), F.count("*").alias("n"))
        .collect()
    )
    content: dict[str, list[str]] = {}
    labelled: Counter[str] = Counter()
    for row in sorted(rows, key=lambda r: (r.lang, r.bucket)):
        content.setdefault(row.lang, []).append(row.text)
        labelled[row.lang] += row.n
    order = sorted(content, key=lambda lang: (-labelled[lang], lang))
    return {lang: _words(" ".join(content[lang])).encode() for lang in order}


def _words(text: str) -> str:
    return f" {' '.join(text.lower().split())} "


class Judge:
    """Compresses with every language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        self._langs = list(content)
        self._levels = [[self._compressor(data, level) for data in content.values()] for level in LEVELS]

    @staticmethod
    def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
        found = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        found.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level, dict_data=found, write_content_size=False)

    def __call__(self, text: str) -> tuple[str, float]:
        if not any(map(str.isalpha, text)) or not self._langs:
            return UNKNOWN, 0.0
        if len(self._langs) == 1:
            return self._langs[0], 1.0
        plain = _words(text)
        blocks = [plain[i : i + BLOCK_CHARS].encode() for i in range(0, len(plain), BLOCK_CHARS)]
        for compressors in self._levels:
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
            least, following = sorted(sizes)[:2]
            lead = (following - least) / following
            if lead >= UNSURE:
                break
        return self._langs[sizes.index(least)], lead


def _verdict(content: dict[str, bytes], narrow: float):
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def verdict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(content)
        for column in columns:
            found = (judge(text.as_py() or "") for text in column)
            rows = [{"lang_pred": g, "score": s, "rejected": s < narrow or g == UNKNOWN} for g, s in found]
            yield pa.array(rows, kind)

    return verdict


def language_of(
    docs: DataFrame, content: dict[str, bytes], narrow: float = NARROW, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    verdict = _verdict(content, narrow)
    return texts(docs, id_col, text_col).select("doc_id", verdict("text").alias("v")).select("doc_id", "v.*")


def in_clear_language(docs: DataFrame, content: dict[str, bytes], narrow: float = NARROW, text_col="text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""
    return docs.filter(~_verdict(content, narrow)(F.col(text_col).cast("string"))["rejected"])
