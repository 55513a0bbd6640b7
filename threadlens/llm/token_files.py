"""Token ids in ORC files that are read stripe by stripe and pruned by their metadata.

Texts are sorted by document id (rows of equal ids by their place) across the files, encoded where they have arrived and written by Spark's ORC
writer: ids and positions as integers, which ORC run-length encodes (version 2), in stripes of ``stripe`` bytes that different tasks can read, with a
row index entry every ``stride`` rows and Bloom filters on the document id. A row holds its document's id, the number of its file, the
ids before it in the file, its count and its token ids. The table of contents (``parts``), written after the files from their
position columns alone, has one row a file: its name, first and last document id, rows, ids, and how many ids stand in the files before it.

``read_ids`` adds the position in the whole collection; with ``wanted`` or ``between`` it opens only the files whose range of document
ids fits, and ORC's reader skips the stripes and row groups that statistics and Bloom filters rule out. ``read_span`` gives a stretch of the whole
collection's ids, from the files and documents that overlap it.

Encoding asks the tokenizers library once for each new word: this vocabulary drops white space, normalises without looking past it and never
merges across it, so a text's ids are those of its words side by side. Each Python worker remembers up to ``remembered`` words, which
changes time only.

Defined cases: null counts as empty and gives the end id alone; a null document id sorts first; rows of one document id, also a third of all, are dealt
to several files, for the place takes part in the sort; repeated rows are all written; strings of added tokens become their ids, as the library
does by default; bytes that aren't UTF-8 are read as U+FFFD; an empty table gives no files and an empty result; other columns are
not stored.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.llm.bpe import byte_letters, vocabulary
from threadlens.llm.common import arrow_limits, blocks, text_views, tidy
from threadlens.llm.places import AT, FILE, placed, stored
from threadlens.session import table
from threadlens.work import Workspace

IDS = "doc_id long, part int, at long, n_tokens int, ids array<int>"
PARTS = "part int, file string, first_id long, last_id long, rows long, tokens long, start long"


#: Letters of ASCII and of U+00C0 to U+00FF, which are each a letter of its own however their neighbours look.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
#: A word of such letters between signs that the vocabulary's pattern splits off whatever they stand beside.
SHAPE = re.compile(rb"""([(\[{"]*)(%b)([.,;:!?)\]}"#$%%&*|]*)""" % LETTERS).fullmatch
#: The lower case of such letters, byte by byte: a capital's second byte lies 32 below.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
#: The letters that stand for bytes in the vocabulary, but a space between words.
SPACED = "".join(byte_letters()[b] if b != 32 else " " for b in range(256))
#: Longer words are neither sent with others nor remembered.
LONG = 64


class Words(dict):
    """Packed little-endian ids of words (white space apart), asked from the tokenizers library when first met.

    A word of letters with signs around it is put together from its parts, and letters are asked for in lower case, since the
    vocabulary lowers them; so fewer words are new. Lower-case letters are what normalising and splitting leave as they are, so they
    go to the library's model without these steps.
    """

    def __init__(self, path: str, remembered: int = 1_000_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: lower-case beginnings of texts that must not be lowered: of added tokens, which are matched as they are written, and of
        #: U+0300 to U+037F, marks that may make another letter of a lower-case one than of its capital
        self.cased = [*{t.content.lower().encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}, b"\xcc", b"\xcd"]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def _letters(self, words: list[bytes], together: int = 500) -> None:
        """Words of lower-case ``LETTERS`` alone, many as one text: each ends with a token that ends a word."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        if not groups:
            return
        for g, e in zip(groups, self.model.encode_batch_fast([codecs.charmap_decode(b" ".join(g), "strict", SPACED)[0] for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<i4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(g):  # a letter that the vocabulary doesn't know
                self._any(g)
                continue
            packed, at = ids.tobytes(), 0
            for w, end in zip(g, (cuts * 4).tolist()):
                self[w] = packed[at:end]
                at = end

    def _any(self, words: list[bytes], together: int = 500) -> None:
        """Words of any signs, many at a time; the library says which word an id belongs to. Long ones go alone."""
        short, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        groups = [short[i : i + together] for i in range(0, len(short), together)] + [[w] for w in long]
        if not groups:
            return
        given = [[w.decode("utf-8", "replace") for w in g] for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch(given, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(e.ids, "<i4")
            cuts = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(g) + 1)) if len(ids) else np.zeros(len(g) + 1, np.int64)
            for w, a, b in zip(g, cuts, cuts[1:]):
                self[w] = ids[a:b].tobytes()

    def learn(self, words: Iterable[bytes]) -> None:
        letters, others, made = set(), set(), []
        for w in words:
            if len(w) > LONG:
                others.add(w)
            elif w.isalpha():  # of bytes, ASCII alone
                core = w.lower()
                letters.add(core)
                if core != w:
                    made.append((w, b"", core, b""))
            elif m := SHAPE(w):
                before, core, after = m.groups()
                core = core.translate(LOWER)
                letters.add(core)
                if before:
                    others.add(before)
                if after:
                    others.add(after)
                if core != w:
                    made.append((w, before, core, after))
            else:
                others.add(w)
        self._letters([w for w in letters if w not in self])
        self._any([w for w in others if w not in self])
        for w, before, core, after in made:
            self[w] = (before and self[before]) + self[core] + (after and self[after])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words, edges = [], [0]
        for t in texts:
            low = t.lower()  # of bytes, ASCII alone
            words += (t if any(c in low for c in self.cased) else low).split()  # of bytes, it splits at [\x20\x09-\x0D] alone
            edges.append(len(words))
        if len(self) > self.remembered:
            self.clear()
        packed = list(map(self.get, words))
        new = list(compress(range(len(packed)), map(is_, packed, repeat(None))))
        if new:
            met = {words[i] for i in new}
            self.learn(met)
            for i in new:
                packed[i] = self[words[i]]
            for w in [w for w in met if len(w) > LONG]:
                del self[w]
        return [b"".join(packed[a:b]) for a, b in zip(edges, edges[1:])]


_loaded: dict[str, Words] = {}


def loaded(path: str) -> Words:
    """One vocabulary a worker process."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def write_ids(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None, end: int = 1, stripe: int = 64 << 20, stride: int = 1000, fpp: float = 0.01
) -> None:
    """Write every text's ids, each with ``end`` after them, below ``path``: the files in ``ids``, their contents in ``parts``."""
    spark = docs.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = loaded(vocab or vocabulary("word_bpe_49k.json")), TaskContext.get().partitionId(), 0
        last = np.array([end], "<i4").tobytes()
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            for a, b in blocks(offsets):
                packed = words.encode([data[i:j].tobytes() for i, j in zip(offsets[a:b], offsets[a + 1 : b + 1])])
                flat = np.frombuffer(last.join([*packed, b""]), np.int32)
                n = np.array([len(x) // 4 + 1 for x in packed], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part), pa.int32()), pa.array(at + ends - n), pa.array(n, pa.int32()), lists]
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "n_tokens", "ids"])

    rows = placed(stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id", FILE, AT).sortWithinPartitions("doc_id", FILE, AT).select("doc_id", "text")
    # a stripe's size is looked at every hundred rows, for a row may hold a long text
    options = {"compression": "zstd", "orc.stripe.size": stripe, "orc.rows.between.memory.checks": 100, "orc.row.index.stride": stride, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": fpp}
    ordered.mapInArrow(tidy(run), IDS).write.options(**options).orc(f"{path}/ids")
    files = files_of(spark, f"{path}/ids").groupBy("part").agg(
        F.min("file").alias("file"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")
    )  # a row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as the write had tasks
    files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select(*[c.split()[0] for c in PARTS.split(", ")]).coalesce(1).write.orc(f"{path}/parts")
    work.drop()


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IDS).orc(path).select("doc_id", "part", "n_tokens", F.col("_metadata.file_name").alias("file"))


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The table of contents: a row a file."""
    return spark.read.schema(PARTS).orc(f"{path}/parts")


def _opened(spark: SparkSession, path: str, some: DataFrame) -> DataFrame:
    """Rows of the files that ``some`` rows of the contents name (at most one a task of the write), with ``start``."""
    names = [f"{path}/ids/{r['file']}" for r in some.select("file").collect()]
    rows = spark.read.schema(IDS).orc(names) if names else spark.createDataFrame([], IDS)
    # the contents have a row a file: as many as the write had tasks, so they are sent out
    return rows.join(F.broadcast(some.select("part", F.col("start").alias("before"))), "part").withColumn("start", F.col("before") + F.col("at"))


def read_ids(spark: SparkSession, path: str, wanted: list[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, of the ``wanted`` ids, or of those ``between`` two ids, both included."""
    some, rule = parts(spark, path), None
    if wanted is not None:
        low, high = F.col("first_id"), F.col("last_id")
        listed = F.array(*[F.lit(w).cast("long") for w in sorted(set(wanted))]).cast("array<bigint>")
        some, rule = some.where(F.exists(listed, lambda w: (w >= low) & (w <= high))), F.col("doc_id").isin(*wanted)
    elif between is not None:
        some, rule = some.where((F.col("last_id") >= between[0]) & (F.col("first_id") <= between[1])), F.col("doc_id").between(*between)
    if rule is None:
        rows = spark.read.schema(IDS).orc(f"{path}/ids").join(F.broadcast(some.select("part", F.col("start").alias("before"))), "part").withColumn("start", F.col("before") + F.col("at"))
    else:
        rows = _opened(spark, path, some).where(rule)
    return rows.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def read_span(spark: SparkSession, path: str, first: int, length: int) -> DataFrame:
    """(doc_id, start, ids) of the ids ``first`` to ``first + length - 1`` of the whole collection, cut at document borders."""
    some = parts(spark, path).where((F.col("start") < first + length) & (F.col("start") + F.col("tokens") > first))
    rows = _opened(spark, path, some).where((F.col("start") < first + length) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    take = F.least(F.lit(first + length) - F.col("start"), F.col("n_tokens").cast("long")).cast("int") - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def summed(rows: DataFrame) -> DataFrame:
    """``read_ids`` with the unsigned crc32 of each list's little-endian 32-bit ids in their place."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    arrow_limits(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=names)

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to ORC files in the order of their ids and read back."""
    path = Workspace(spark, "op11").path
    write_ids(table(spark, sf_dir, "documents"), path)
    return summed(read_ids(spark, path))
