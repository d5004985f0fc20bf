"""Language identification by hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.session import limit_arrow_batches

DIMENSIONS = 1024
# Characters handled at once, documents profiled at once, and distinct trigrams multiplied at once.
CHARS = 1 << 21
DOCS = 512
GRAMS = 4096
# Prototypes travel to every task: at most this many of DIMENSIONS floats (32 MB). ISO 639-3 names fewer languages.
LANGUAGES = 8000
# Partial prototypes of a language are first added in this many groups.
SALTS = 32
_GAP = 32
_BITS = 21  # a code point fits
_MASK = (1 << _BITS) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=4096)
def _symbol(code: int) -> np.ndarray:
    """The random vector of -1 and 1 of a letter, or of the gap between words: a function of the code point alone."""
    bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return 2 * bits - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Each trigram's vector: its symbols' vectors, rotated by two, one and no places, multiplied."""
    parts = [grams >> 2 * _BITS, grams >> _BITS & _MASK, grams & _MASK]
    symbols = np.unique(np.concatenate(parts))
    base = np.stack([_symbol(int(c)) for c in symbols])
    out = np.ones((len(grams), DIMENSIONS), dtype=np.int8)
    for turn, part in zip((2, 1, 0), parts, strict=True):
        out *= np.roll(base, turn, axis=1)[np.searchsorted(symbols, part)]
    return out


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about CHARS characters, cut where no letter stands."""
    at = 0
    while len(text) - at > CHARS:
        cut = at + CHARS
        while cut < len(text) and text[cut].isalpha():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, trigram) around every letter: the letter in lower case between its neighbours, where
    any run of other characters, and either end of a text, is one gap."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    at = np.flatnonzero(letter | np.concatenate([[True], letter[:-1]]))
    symbols = np.where(letter[at], codes[at], _GAP).astype(np.int64)
    middle = np.flatnonzero(symbols != _GAP)
    grams = (symbols[middle - 1] << 2 * _BITS) | (symbols[middle] << _BITS) | symbols[middle + 1]
    return np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at[middle], side="left"), grams


def profiles(texts: list[str], rows: np.ndarray, n_rows: int) -> np.ndarray:
    """The bundle, n_rows by DIMENSIONS, of each row's texts."""
    out = np.zeros((n_rows, DIMENSIONS))
    pending, held = [], 0

    def add() -> None:
        place, grams = trigrams([t for _, t in pending])
        if not len(grams):
            return
        kinds, which = np.unique(grams, return_inverse=True)
        row = np.array([r for r, _ in pending])[place]
        for first in range(0, len(kinds), GRAMS):
            last = min(first + GRAMS, len(kinds))
            here = slice(None) if last - first == len(kinds) else (which >= first) & (which < last)
            counts = np.bincount(row[here] * (last - first) + which[here] - first, minlength=n_rows * (last - first))
            out[:] += counts.reshape(n_rows, -1).astype(np.float32) @ gram_vectors(kinds[first:last]).astype(np.float32)

    for row, text in zip(rows, texts, strict=True):
        for part in _slices(text):
            pending.append((row, part))
            held += len(part)
            if held >= CHARS:
                add()
                pending, held = [], 0
    if pending:
        add()
    return out


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, vector): the bundle of all trigrams of a language's texts, as little-endian doubles holding whole numbers."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for first in range(0, len(texts), DOCS):
                names, rows = np.unique(langs[first:first + DOCS], return_inverse=True)
                for name, vector in zip(names, profiles(texts[first:first + DOCS], rows, len(names)), strict=True):
                    sums[name] = sums[name] + vector if name in sums else vector
        yield pa.RecordBatch.from_pydict({"lang": [str(x) for x in sums], "vector": [v.astype("<f8").tobytes() for v in sums.values()]},
                                         schema=pa.schema([("lang", pa.string()), ("vector", pa.binary())]))

    def total(held: pd.DataFrame) -> pd.DataFrame:
        vector = sum(np.frombuffer(v, "<f8") for v in held["vector"])
        return pd.DataFrame({"lang": [held["lang"].iloc[0]], "vector": [vector.astype("<f8").tobytes()]})

    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = usable.mapInArrow(partial, "lang string, vector binary")
    salted = parts.groupBy("lang", F.pmod(F.xxhash64("vector"), F.lit(SALTS)).alias("_salt")).applyInPandas(
        total, "lang string, vector binary")
    return salted.groupBy("lang").applyInPandas(total, "lang string, vector binary")


def identify(docs: DataFrame, learn: Column, keep: dict[str, Column], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The columns of `keep`, lang_pred and score of every row.

    Prototypes are bundled from the rows where `learn` holds and that have a language and text. A text's
    trigram bundle is compared with every prototype by cosine; the nearest one's language is given, with
    the cosine held to 0..1 as its score; ties go to the name that sorts first. Text that is NULL or has
    no letter gets `und` and 0, and so does every text if nothing could be learned. Whole texts count.
    Repeated and NULL ids, empty tables and further columns make no difference. More than LANGUAGES
    languages are refused, since every task holds all prototypes.
    """
    limit_arrow_batches(docs.sparkSession)
    found = prototypes(docs.where(learn), lang_col, text_col).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = sorted((r["lang"], np.frombuffer(r["vector"], "<f8")) for r in found)
    found = [(name, v / norm) for name, v in found if (norm := np.linalg.norm(v)) > 0]
    names = [name for name, _ in found]
    matrix = np.stack([v for _, v in found]).astype(np.float32) if found else np.zeros((0, DIMENSIONS), np.float32)
    held = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def compare(batches):
        names, matrix = held.value
        for batch in batches:
            texts, preds, scores = [t or "" for t in batch.column("_text").to_pylist()], [], []
            for first in range(0, len(texts), DOCS):
                some = texts[first:first + DOCS]
                vectors = profiles(some, np.arange(len(some)), len(some))
                norms = np.linalg.norm(vectors, axis=1)
                if names:
                    cosines = vectors.astype(np.float32) @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                    best = cosines.argmax(axis=1)
                    preds += [names[b] if n > 0 else "und" for b, n in zip(best, norms, strict=True)]
                    scores += np.where(norms > 0, cosines[np.arange(len(some)), best].clip(0, 1), 0.0).tolist()
                else:
                    preds, scores = preds + ["und"] * len(some), scores + [0.0] * len(some)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    source = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in source.dtypes[:-1])
    return source.mapInArrow(compare, f"{fields}, lang_pred string, score double")
