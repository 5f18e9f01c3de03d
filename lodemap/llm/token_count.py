"""Token counts: the tokenizer's own batch encoding inside Arrow functions, returning lengths only."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodemap.llm.common import arrow_map, batch, table

#: A run of white space and the rest up to the next one. Byte-level BPE never joins a character that is no white space
#: with white space after it, so a text may be cut before any such run.
_PIECE = re.compile(r"\s*\S+|\s+")
#: White space to Python but not to the tokenizer: texts with these are encoded in one piece.
_ODD = re.compile("[\x1c-\x1f]")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class Counter:
    """Lengths of texts in tokens. Pieces met before are looked up, new ones are encoded in batches of about ``batch_bytes``."""

    def __init__(self, tokenizer: str, batch_bytes: int = 256 << 10, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.batch_bytes, self.remembered, self.known = batch_bytes, remembered, {}

    def learn(self, pieces: list[str]) -> None:
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= self.batch_bytes):
                size += len(pieces[end])
                end += 1
            found = self.encoder.encode_batch_fast(pieces[at:end], add_special_tokens=False)
            self.known.update(zip(pieces[at:end], map(len, found), strict=True))
            at = end

    def lengths(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):  # groups of texts of about batch_bytes * 4 characters
            cut, size, new = [], 0, set()
            while at < len(texts) and (not cut or size + len(texts[at]) <= 4 * self.batch_bytes):
                text = texts[at]
                pieces = [text] if _ODD.search(text) else _PIECE.findall(text)
                new.update(pieces)
                cut.append(pieces)
                size += len(text)
                at += 1
            if len(self.known) > self.remembered:
                self.known.clear()
            self.learn([p for p in new if p not in self.known])
            look = self.known.__getitem__
            out += [sum(map(look, pieces)) for pieces in cut]
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a tokenizers .json file with byte-level pieces, readable on every executor. Special
    strings in a text count as the library's default has it; no begin, end or padding tokens. Null or empty text: 0 and 0.
    Null ids stay null; repeated rows are counted one by one; other columns are ignored; no rows give no rows.
    """
    made: list[Counter] = []

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Counter(tokenizer))
        texts = [t or "" for t in rows.column(1).to_pylist()]
        n = made[0].lengths(texts)
        return batch(SCHEMA, doc_id=rows.column(0), n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(picked, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_token_counts": (op8_token_counts, None)}
