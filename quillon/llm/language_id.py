"""Language ID by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fold, give_back, table

#: Bounds of the fitted model: texts for each language, characters of each, bytes of a dictionary, languages.
SAMPLE_TEXTS = 96
SAMPLE_CHARS = 2048
DICT_BYTES = 1 << 16
MAX_LANGUAGES = 512
#: Texts are compressed in pieces, so that a long one keeps being measured against the dictionary, not against itself.
PIECE = 2048
LEVEL = 6
MIN_MARGIN = 0.002
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The lower-cased letters of a text, with one space for whatever stands between them."""
    return OTHER.sub(" ", text).lower().encode()


def fit_dictionaries(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, dict_bytes: int = DICT_BYTES
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample: sample_texts texts a language, chosen by hash, of the
    first SAMPLE_CHARS characters of each what fills its share of dict_bytes. Rows without text or language teach
    nothing; with more than MAX_LANGUAGES languages the commonest are learned."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).where(F.length(text_col) > 0)
    common = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, 2.0 * sample_texts / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.select(F.col(lang_col).alias("_lang"), place.alias("_place"), share.alias("_share"), F.substring(text_col, 1, SAMPLE_CHARS).alias("_text"))
    # at most about twice sample_texts rows of each language
    some = chosen.where("_place < _share").limit(4 * sample_texts * len(counts)).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        mine = sorted((r["_place"], r["_text"]) for r in some if r["_lang"] == lang)[:sample_texts]
        if mine:
            each = max(64, dict_bytes // len(mine))
            out[lang] = b" ".join(letters(t)[:each] for _, t in mine)[-dict_bytes:]
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns of docs with lang_pred, score, margin and rejected.

    lang_pred is the language whose dictionary gives the fewest bytes over the whole text (ties: the first in the
    model, which is the commonest), `und` with score 0 where the text is null or has no letter or nothing was learned.
    margin is what the second-best costs more, as a share of it; rejected marks `und` and margins under min_margin.
    Repeated rows are decided alike; columns of these names in docs are replaced.
    """
    names = list(dictionaries)
    raw = [dictionaries[x] for x in names]

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for data in raw:
            book = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            langs, scores, margins = [], [], []
            for text in batch:
                if text is None or not coders or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                whole = letters(text)
                pieces = [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in coders], float)
                best = int(sizes.argmin())
                gap = sizes - sizes[best]
                scores.append(float(1 / np.exp(-gap / (2 + 0.02 * sizes[best])).sum()))
                rest = np.delete(sizes, best)
                margins.append(float(1 - sizes[best] / rest.min()) if len(rest) else 1.0)
                langs.append(names[best])
            margin, lang = np.array(margins, float), np.array(langs, object)
            yield pd.DataFrame({"lang_pred": lang, "score": scores, "margin": margin, "rejected": (lang == "und") | (margin < min_margin)})
            give_back()

    rows = docs.drop("lang_pred", "score", "margin", "rejected")
    found = rows.withColumn("_found", decide(F.col(text_col).cast("string")))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "_found.*")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 3) != 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    books = fit_dictionaries(training_rows(docs))
    found = identify(docs.select("doc_id", "text"), books)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")
