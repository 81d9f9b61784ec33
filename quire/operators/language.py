"""Language identification by character trigrams, with probabilities; deterministic.

A profile has (gram, lang, weight): how much likelier a trigram is in a language
than a trigram that the language doesn't have, as the logarithm in thousandths, a
whole number. A text's score for a language is the sum over its trigrams, which
is exact in any order, and its probabilities are the softmax of the mean scores,
sharpened by ``SHARPNESS``; so a text of two languages has two probable ones.

``profile`` makes the built-in model of nine languages out of frequent words;
``learn`` makes one from labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import language_code, strip

# Frequent words by language, of which the built-in profile is made.
FREQUENT = {
    "ca": "el la els les de del dels i a en un una que no és per amb al als com més però si ja aquest aquesta són hi ha va quan molt també seva seu fins des on sobre",
    "de": "der die das und ist nicht ein eine zu den von mit sich des auf für dem als auch es an werden aus er hat dass sie nach wird bei noch wie einem über einen so zum war aber",
    "en": "the of and to in is that it was for on are as with his they be at one have this from or had by but not what all were we when your can said there an",
    "es": "de la que el en y los se del las por un para con una su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde",
    "eu": "eta da ez bat dira du ere zen izan dela hori egin baina duen ditu dute edo baino bere beste nahi behar guztiak gero oso hau horrek zuen ziren dago egiten hemen bai",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou aux son mais comme nous leur être cette elle",
    "gl": "o a os as de do da dos das e en un unha que non é por para con ao como máis pero se xa este esta son hai foi cando moi tamén súa seu ata desde onde sobre nos nas",
    "it": "di che la il un è per in una non sono con si da come le dei nel alla più anche ma gli della del lo al delle ha questo questa ci quando molto era suo sua loro essere",
    "pt": "de que o a e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já também pelo pela até isso ela entre depois",
}
SHORTEST, FALLBACK = 10, "spa"
#: A text whose every trigram is e times as likely in one language as in another has odds of e to this power.
SHARPNESS = 12.0
#: Trigrams that a learned language keeps, the most frequent ones, and the share of a trigram that it doesn't have.
GRAMS, FLOOR = 500, 1e-4
PROFILE = "gram string, lang string, weight long"


def seed_weights() -> list[tuple[str, str, int]]:
    """(gram, lang, weight) of the built-in model: trigrams of words between spaces, a word's share falling with its place in the list."""
    out = []
    for lang, listed in sorted(FREQUENT.items()):
        shares: Counter[str] = Counter()
        for place, word in enumerate(listed.split()):
            padded = f" {word} "
            for k in range(len(word)):
                shares[padded[k : k + 3]] += 1 / (place + 10)
        total = sum(shares.values())
        out += [(gram, lang, round(1000 * math.log(max(share / total, FLOOR) / FLOOR))) for gram, share in sorted(shares.items())]
    return out


def profile(spark: SparkSession) -> DataFrame:
    """The built-in model of nine languages, of some 1500 rows."""
    return spark.createDataFrame(seed_weights(), PROFILE)


#: Texts are counted in pieces of about so many letters, and of so many texts at most.
PIECE, TEXTS = 1 << 20, 1024


def letters(text: Column) -> Column:
    """The words of a text in lower case, with one space for whatever is between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def _pieces(texts: pa.Array):
    """(first, strings) of neighbouring texts, null ones empty."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= PIECE or len(held) == TEXTS:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of its text) of the trigram around each letter, words being between spaces."""
    codes = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])
    keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    letter = codes[1:-1] != 32
    return keys[letter], own[: len(keys)][letter]


def _key(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = GRAMS) -> DataFrame:
    """A profile of the languages of labelled documents: ``most`` trigrams each; rows without a language are passed over."""

    def count(batches):
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            names, numbers = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            for first, texts in _pieces(batch["text"]):
                keys, own = _keys(texts)
                own = numbers[first + own]
                for k in np.unique(own):
                    found, n = np.unique(keys[own == k], return_counts=True)
                    points = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype(np.uint32)
                    grams = points.view("U3").ravel().tolist()
                    yield pa.RecordBatch.from_arrays([pa.repeat(names[int(k)], len(grams)), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), letters(F.col(text_col)).alias("text"))
    n = rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang")
    n = n.withColumn("total", F.sum("n").over(own)).withColumn("nth", F.row_number().over(own.orderBy(F.desc("n"), "gram"))).where(F.col("nth") <= most)
    weight = F.round(1000 * F.ln(F.greatest(F.col("n") / F.col("total"), F.lit(FLOOR)) / FLOOR)).cast("long")
    return n.select("gram", "lang", weight.alias("weight"))


def _matched(docs: DataFrame, model: list[tuple[str, str, int]], known: list[str]) -> DataFrame:
    """(doc_id, short, n, lang, score): a row for each language that a text has trigrams of, or one with null; ``n`` is in a text's first row, else 0."""
    place = {lang: k for k, lang in enumerate(known)}
    listed = sorted((_key(gram), place[lang], weight) for gram, lang, weight in model if len(gram) == 3)
    keys, langs, weights = (np.array([x[k] for x in listed], np.int64) for k in range(3))
    grams, first, entries = np.unique(keys, return_index=True, return_counts=True)

    def run(batches):
        names = pa.array(known, pa.string())
        for batch in batches:
            n = batch["n"].to_numpy(zero_copy_only=False)
            for start, texts in _pieces(batch["text"]):
                found, own = _keys(texts)
                at = np.searchsorted(grams, found)
                hit = at < len(grams)
                hit[hit] = grams[at[hit]] == found[hit]
                at, own = at[hit], own[hit]
                many = entries[at]
                entry = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pair, slot = np.unique(np.repeat(own, many) * len(known) + langs[entry], return_inverse=True)
                scores = np.bincount(slot, weights[entry], len(pair)).astype(np.int64)  # exact below 2^53
                row, lang = pair // max(len(known), 1), pair % max(len(known), 1)
                bare = np.setdiff1d(np.arange(len(texts)), row)
                row, begins = np.concatenate([row, bare]), np.concatenate([np.diff(row, prepend=-1) > 0, np.ones(len(bare), bool)])
                lang, scores = (np.concatenate([x, np.zeros(len(bare), np.int64)]) for x in (lang, scores))
                none = np.arange(len(row)) >= len(pair)
                ids, short = (batch[c].take(pa.array(start + row)) for c in ("doc_id", "short"))
                yield pa.RecordBatch.from_arrays([ids, short, pa.array(np.where(begins, n[start + row], 0)), names.take(pa.array(lang, mask=none)), pa.array(scores, mask=none)], ["doc_id", "short", "n", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, short boolean, n long, lang string, score long")


def scored(docs: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, short, scores) for each id: whether the text is too short, and (lang, prob) of every language of the model, the most probable first, ties by name.

    Probabilities add up to 1. A text without a trigram of the model has no
    scores, nor has any text if the model is empty. Rows of one id count
    together, and are short if all are. The model, some hundred trigrams a
    language, is read at once and sent along with the tasks.
    """
    weights = seed_weights() if model is None else [tuple(r) for r in model.select("gram", "lang", "weight").collect()]
    known = sorted({lang for _, lang, _ in weights})
    short = F.coalesce(F.length(strip(F.col(text_col))) < SHORTEST, F.lit(True))
    d = docs.select(F.col(id_col).alias("doc_id"), short.alias("short"), letters(F.col(text_col)).alias("text"))
    d = d.withColumn("n", F.coalesce(F.length(F.translate("text", " ", "")), F.lit(0)).cast("long"))
    d = _matched(d, weights, known).groupBy("doc_id", "lang").agg(F.sum("score").alias("score"), F.sum("n").alias("n"), F.min("short").alias("short"))
    pairs = F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "score")))
    d = d.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("short").alias("short"), pairs.alias("own")).withColumn("own", F.when(F.size("own") > 0, F.map_from_entries("own")))
    mean = lambda lang: F.coalesce(F.try_element_at("own", lang), F.lit(0)) / (1000.0 * F.col("n"))
    names = F.array(*[F.lit(x) for x in known]) if known else F.array().cast("array<string>")
    d = d.withColumn("e", F.when(F.col("own").isNotNull(), F.transform(names, lambda x: F.struct(F.exp(SHARPNESS * mean(x)).alias("e"), x.alias("lang")))))
    d = d.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x["e"]))
    ranked = F.array_sort(F.transform("e", lambda x: F.struct((-F.round(x["e"] / F.col("total"), 9)).alias("less"), x["lang"].alias("lang"))))
    scores = F.transform(ranked, lambda x: F.struct(x["lang"].alias("lang"), (-x["less"]).alias("prob")))
    return d.select("doc_id", "short", F.coalesce(scores, F.array().cast("array<struct<lang:string,prob:double>>")).alias("scores"))


def languages(short: Column, scores: Column, most: int = 2, least: float = 0.1) -> Column:
    """Codes of the ``most`` probable languages above ``least``; short or undecided texts are Spanish."""
    found = F.transform(F.filter(F.slice(scores, 1, most), lambda s: s["prob"] > least), lambda s: language_code(s["lang"]))
    return F.when(~short & (F.size(found) > 0), found).otherwise(F.array(F.lit(FALLBACK)))


def language(short: Column, scores: Column) -> Column:
    """The code of the most probable language; short or undecided texts are Spanish."""
    return F.get(languages(short, scores, 1, 0.0), F.lit(0))


def spanish_dominant(short: Column, scores: Column, share: float = 0.5) -> Column:
    """Short and undecided texts count as Spanish."""
    spanish = F.exists(scores, lambda x: (x["lang"] == "es") & (x["prob"] >= share))
    return short | (F.size(scores) == 0) | spanish


def with_languages(docs: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, languages) for each id."""
    d = scored(docs, model, id_col, text_col)
    return d.select("doc_id", languages(F.col("short"), F.col("scores")).alias("languages"))
