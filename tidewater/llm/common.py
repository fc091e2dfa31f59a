"""Shared parts of the training-data operators: scratch tables, sizes, Arrow helpers, tokenizing."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of source text that one shard of a re-partitioned operator should hold.
SHARD_BYTES = 16 << 20
#: Partitions that a shuffle has at most.
MOST_PARTS = 20_000
#: Bytes of text that a Python function takes in at a time (about; one text is never cut).
PIECE_BYTES = 2 << 20
#: Rows of an Arrow batch; Spark's default of 10,000 whole texts is too much off-heap memory for a small executor.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session; where it is unset one of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='tidewater-')}")
    return found.rstrip("/")


_LEFT: list[tuple[SparkSession, str]] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LEFT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewater_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Delete tables made by :func:`table` that no later step reads."""
    for df in dfs:
        _delete(df.sparkSession, df._tidewater_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT[:] = [x for x in _LEFT if x[1] != path]


@atexit.register
def _tidy() -> None:
    for spark, path in list(_LEFT):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and its scratch folder is the cluster's to clear
            return


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer expects ``df`` to hold (file sizes, for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards(df: DataFrame, shard_bytes: int = SHARD_BYTES, text: str = "text") -> int:
    """A number of shards that grows with the input: at least the session's, and one for each ``shard_bytes`` of text.

    Sizes come from the optimizer (files are taken to be compressed to half); where it knows none, the texts are measured."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 2 * plan_bytes(df)
    if size >= 1 << 52:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-size // shard_bytes))


def parts(n: int) -> int:
    """Partitions for ``n`` shards: Spark's driver bears only so many, beyond which a task takes several shards, one after another."""
    return min(n, MOST_PARTS)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow, with batches cut into ``rows`` rows or about ``PIECE_BYTES`` (0: as they come), so that few whole texts are Python objects at a time.

    Spark takes the size of its own batches from the session when the query runs, so a larger ``maxRecordsPerBatch`` of the session
    is lowered to ``BATCH_ROWS`` and stays so."""

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def pieces(batches):
        for b in batches:
            n = min(rows, max(1, PIECE_BYTES * b.num_rows // max(1, b.nbytes)))
            for k in range(0, b.num_rows, n):
                yield b.slice(k, n)

    def cut(batches):
        return f(pieces(batches)) if rows else f(batches)

    return df.mapInArrow(cut, schema)


def strings(col: pa.Array) -> list[str | None]:
    return col.to_pylist()


#: The separators of the contracts' words: ``[^\x20\x09-\x0D]+`` are the words.
SPACES = " \t\n\x0b\x0c\r"


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split cuts at exactly these six bytes)."""
    return text.encode("utf-8", "surrogatepass").split()


def with_columns_kept(docs: DataFrame, needed: list[str]) -> DataFrame:
    """Only the columns an operator reads, under their own names; extra columns with any names stay out of its way."""
    return docs.select(*[F.col(c) for c in needed])


# -- tokenizing ---------------------------------------------------------------------------------

#: White space as the tokenizer's own pattern has it; str.split() takes \x1c-\x1f besides.
_WIDE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
_MARKS = frozenset(".,;:!?")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable letters: those that print as themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    letter = [chr(b if b in own else next(other)) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def _narrow(text: str) -> bool:
    """Whether all letters are below U+0100: such text is in NFC, and its lower case has no rules of context."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Word -> ids as little-endian unsigned 16-bit; unknown words are encoded as they are met.

    The pieces that a word is made of are words themselves, so a rare word is mostly put together from known ones. When
    ``most`` words are kept they become the older generation, from which words come back when they are met again."""

    def __init__(self, tok, most: int):
        self.tok, self.model, self.most, self.older = tok, tok.model, most, {}
        self.letters = _byte_letters()
        shape = json.loads(tok.to_str())
        #: Whether the model may be asked piece by piece: this normalizer and pre-tokenizer are the ones that _PIECES repeats.
        self.plain = (
            [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in (shape["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and shape["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _PIECES.pattern
        )

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        if not self.plain or "<|" in word or not (word.isascii() or _narrow(word)):
            return np.array(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()
        low = word.lower()
        if low[-1:] in _MARKS and low[:-1].isalpha():  # the shape that _PIECES would cut most often
            return self[low[:-1]] + self[low[-1]]
        pieces = [low] if low.isalpha() else _PIECES.findall(low)
        if pieces == [low]:  # by the library's model (letters below U+0100 are their own NFC form)
            return array("H", [t.id for t in self.model.tokenize(low if low.isascii() and low.isalpha() else low.translate(self.letters))]).tobytes()
        return b"".join([self[x] for x in pieces])


class WordEncoder:
    """Ids of whole texts by the tokenizers library; each worker keeps the ids of words it has seen.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its
    white-space-separated words in order (tests hold this against the library's ``encode`` of whole texts).
    At most twice ``most`` words are kept.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if tok.get_vocab_size() > 65536:
            raise ValueError("the vocabulary has more ids than 16 bits hold")
        self.tok, self.known = tok, _Words(tok, most)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (unsigned 16-bit) of a whole text; null: none."""
        if not text:
            return np.empty(0, dtype="<u2")
        if _ODD.search(text):
            cut = _WIDE.findall(text)
        elif "<|" not in text and _narrow(text):
            cut = text.lower().split()  # the same letters, fewer different words (special tokens are told apart by case)
        else:
            cut = text.split()
        return np.frombuffer(b"".join(map(self.known.__getitem__, cut)), dtype="<u2")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The Python worker's encoder for this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
