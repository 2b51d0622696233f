"""Problem 6: encoding a corpus with a public tokenizer through a table of its distinct words.

Texts are split into the tokenizer's words in Spark, block by block; a block keeps each of its words once
and its texts as positions into them. Each distinct word of the corpus is encoded once; the ids go back to
the blocks and are joined by position. Decoding is a join of ids with their byte pieces.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the word pattern that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block is closed at so many rows or characters; one longer text is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 2000, 2_000_000


def ranks_of(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Byte pieces and ids of a byte-level vocabulary, from its ``.tiktoken`` or ``.json`` file."""
    path = f"{folder}/{name}.tiktoken"
    if os.path.exists(path):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # the usual printable stand-ins for bytes
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(back[c] for c in piece): i for piece, i in vocab.items() if all(c in back for c in piece)}


_ENCODERS: dict = {}


def _encoder(ranks: dict[bytes, int], name: str):
    if name not in _ENCODERS:
        import tiktoken

        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def _split(batches):
    import regex
    from pyspark import TaskContext

    words = regex.compile(PATTERN).findall
    tag = TaskContext.get().partitionId() << 32

    def close(docs, index, tag):
        kind = np.uint16 if len(index) <= 1 << 16 else np.uint32
        yield pd.DataFrame({"block": tag, "id": [a for a, _ in docs], "word": None, "places": [p.astype(kind).tobytes() for _, p in docs], "place": -np.dtype(kind).itemsize})
        yield pd.DataFrame({"block": tag, "id": -1, "word": list(index), "places": None, "place": np.arange(len(index), dtype=np.int32)})

    docs, index, chars = [], {}, 0
    for pdf in batches:
        for key, text in zip(pdf["id"], pdf["text"]):
            if docs and (len(docs) >= BLOCK_ROWS or chars + len(text) > BLOCK_CHARS):
                yield from close(docs, index, tag)
                docs, index, chars, tag = [], {}, 0, tag + 1
            put = index.setdefault
            docs.append((key, np.fromiter((put(w, len(index)) for w in words(text)), np.uint32)))
            chars += len(text)
    if docs:
        yield from close(docs, index, tag)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts: bool = False) -> DataFrame:
    """``id_col`` (a whole number, unique) and ``ids`` ARRAY<INT>, or ``n_tokens`` if ``counts``.

    A null or empty text has an empty list (0 tokens). Strings of special tokens in a text are ordinary
    text. Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(ranks_of(name, folder))  # of fixed size
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = texts.where("text is not null and text <> ''")
    parts = written(full.mapInPandas(_split, "block long, id long, word string, places binary, place int"), "words")
    kind = np.uint16 if max(ranks.value.values()) < 1 << 16 else np.uint32

    def encode(batches):
        enc, last, code = _encoder(ranks.value, f"{folder}/{name}").encode_ordinary, None, None
        for pdf in batches:
            out = []
            for word in pdf.word:
                if word != last:  # the rows are sorted by word, so that each word is encoded once
                    last, code = word, enc(word)
                    code = np.array([len(code)], np.uint32).tobytes() if counts else np.array(code, kind).tobytes()
                out.append(code)
            yield pd.DataFrame({"block": pdf.block, "place": pdf.place, "code": out})

    words = parts.where("place >= 0").select("word", "block", "place").repartition("word").sortWithinPartitions("word")
    codes = words.mapInPandas(encode, "block long, place int, code binary")
    docs = parts.where("place < 0").select(F.col("block").alias("doc_block"), "id", "places", "place")

    def join_ids(docs: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        own = codes.code.to_numpy()[np.argsort(codes.place.to_numpy())]
        flat = np.frombuffer(b"".join(own), np.uint32 if counts else kind).astype(np.int32)
        size = np.fromiter(map(len, own), np.int64, len(own)) // (4 if counts else np.dtype(kind).itemsize)
        at = np.cumsum(size) - size
        out = []
        for places, width in zip(docs.places, docs.place):
            p = np.frombuffer(places, np.uint16 if width == -2 else np.uint32)
            n = size[p]
            ids = flat[np.repeat(at[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append(int(ids.sum()) if counts else ids)
        return pd.DataFrame({"id": docs.id, "code": out})

    done = docs.groupBy("doc_block").cogroup(codes.groupBy("block")).applyInPandas(join_ids, "id long, code long" if counts else "id long, code array<int>")
    none = texts.where("text is null or text = ''").select("id", (F.lit(0).cast("long") if counts else F.array().cast("array<int>")).alias("code"))
    return done.unionByName(none).toDF(id_col, "n_tokens" if counts else "ids")


def piece_table(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``piece_id`` and its bytes ``piece``: one row an id, of the vocabulary's fixed size."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks_of(name, folder).items()], "piece_id int, piece binary")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, pieces: DataFrame, slice_ids: int | None = None) -> DataFrame:
    """``id_col`` and ``text`` of the id lists, by a join with ``pieces``; an empty or null list gives an empty text.

    An id without a piece, or a null one, is left out; bytes that are no UTF-8 give replacement characters.
    With ``slice_ids`` the pieces of so many ids are put together first, so that a very long text is no
    single list of pieces, and the lists are shuffled ahead of the join instead of their pieces behind it.
    """
    df = df.repartition(id_col) if slice_ids else df
    each = df.select(id_col, F.posexplode_outer(ids_col).alias("pos", "piece_id")).join(F.broadcast(pieces), "piece_id", "left")
    part = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))
    if slice_ids:
        each = each.withColumn("slice", F.floor(F.col("pos") / slice_ids)).groupBy(id_col, "slice").agg(F.array_sort(part).alias("p"))
        each = each.select(id_col, "slice", F.array_join(F.transform("p", lambda x: x["h"]), "").alias("h"))
        part = F.collect_list(F.struct("slice", "h"))  # bytes of one character may lie in two slices, so that only the whole is decoded
    joined = each.groupBy(id_col).agg(F.array_sort(part).alias("p"))
    return joined.select(id_col, F.make_valid_utf8(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).cast("string")).alias("text"))


def text_round_trip(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and ``exact``: 1 where decoding the whole text's ids gives the text back, else 0; a null text counts as empty."""
    coded = encode_corpus(df, id_col, text_col, name, folder)
    back = decode_ids(coded, id_col, "ids", piece_table(df.sparkSession, name, folder), slice_ids=1000)
    own = df.select(F.col(id_col).cast("long").alias(id_col), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("own"))
    same = F.coalesce(F.col("own") == F.col("back"), F.lit(False)).cast("long")
    return own.join(back.select(id_col, F.sha2("text", 256).alias("back")), id_col, "left").select(id_col, same.alias("exact"))


def word_round_trip(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Each distinct word of the corpus with its token count and whether decoding gives it back: ``word_length``, ``words``, ``tokens``, ``exact``."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(ranks_of(name, folder))

    @F.pandas_udf("array<string>")
    def own_words(s: pd.Series) -> pd.Series:
        import regex

        split = regex.compile(PATTERN).findall
        return pd.Series([list(set(split(t))) for t in s])

    words = df.where(F.col(text_col).isNotNull()).select(F.explode(own_words(F.col(text_col))).alias("word")).distinct()

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        enc = _encoder(ranks.value, f"{folder}/{name}").encode_ordinary
        return pd.Series([enc(w) for w in s])

    coded = written(words.select("word", encode("word").alias("ids")), "coded")
    text = decode_ids(coded, "word", "ids", piece_table(spark, name, folder))
    size = coded.select("word", F.size("ids").alias("tokens"))
    return (
        text.join(size, "word").groupBy(F.length("word").cast("long").alias("word_length"))
        .agg(F.count("*").alias("words"), F.sum("tokens").alias("tokens"), F.sum((F.col("word") == F.col("text")).cast("long")).alias("exact"))
    )
