"""Two tokenizers aligned over the same bytes.

Both tokenizers' ids of a text come with the offsets at which tokens end. Offsets where both end cut
the text into groups; inside a group, tokens whose bytes overlap are linked. How many documents hold
an id pair linked is counted over the corpus, and every document is told how its links rank.

Neither tokenizer has a token across a space or line end that follows something else, nor across a
letter and the stop or comma behind it, so a text is tokenized in *chunks* cut there, each distinct
one once per Python worker while it is remembered.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Pairs (9 bytes each) whose counts may be sent to every task; those of more pairs are joined.
SENT_PAIRS = 1 << 22
#: Chunks that a Python worker remembers (some 500 bytes each), in two generations of so many, and
#: the longest of them.
REMEMBERED, LONGEST = 60_000, 64

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(rf"\s*(?:[{_L}]+(?![^ \n.,])|\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*$)?)|\s+$")

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write each byte with: printable ones stand for
    themselves, all others take the characters from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """Ids by a byte-level vocabulary file, and the bytes of each id.

    A file whose merges make its ids in order, as they do where ids are ranks, is read by the faster
    of two libraries; both give the same ids then, which a test compares.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_letters()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = {i: t.encode() if i in special else bytes(byte_of[c] for c in t) for t, i in vocabulary.items()}
        model = json.loads(self.tokenizer.to_str())["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.fast = None
        if all(vocabulary[x + y] == 256 + k for k, (x, y) in enumerate(pairs)):
            import public_tokenizers
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.tokenizer = None  # some 60 MB

    def encode(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_all(self, chunks: list[str]) -> list[int]:
        """The ids of all chunks, one after the other. Chunks of a space and something else that ends in no
        white space are cut there anyhow, so they are tokenized as one text."""
        out, run = [], []
        for c in chunks:
            if c[0] == " " and not c[1:2].isspace() and len(c) > 1 and not c[-1].isspace():
                run.append(c)
                continue
            if run:
                out += self.encode("".join(run))
                run = []
            out += self.encode(c)
        return out + self.encode("".join(run)) if run else out


class PieceTokenizer:
    """Ids by a piece vocabulary file with byte pieces, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.line, self.space = self.model.encode("\n"), [self.model.piece_to_id("▁")]

    def encode_all(self, chunks: list[str]) -> list[int]:
        """As above. The tokenizer adds a space to each chunk: one that starts with a space loses its own,
        any other gets a line end first, with which no piece is joined, and loses both ids again."""
        spaced = [c[0] == " " for c in chunks]
        out = []
        for ids, s in zip(self.model.encode([c[1:] if s else "\n" + c for c, s in zip(chunks, spaced, strict=True)], num_threads=1), spaced, strict=True):
            out += (ids or self.space) if s else ids[len(self.line) :]
        return out


def ends(ids: list[int], of: dict[int, bytes]) -> list[int]:
    """The byte offsets at which tokens end."""
    return list(itertools.accumulate(map(len, map(of.__getitem__, ids))))


def common_cuts(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int]]:
    """The ends that both tokenizers have, in order, each with the numbers of tokens up to it.

    Ends are keys of one dictionary for each tokenizer, which gives the index of the token that
    ends there; the sorted common keys cut both lists of ids.
    """
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True)), dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    for end in sorted(index_a.keys() & index_b.keys()):
        yield end, index_a[end], index_b[end]


def links(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> list[int]:
    """Sums of the ids of one group whose bytes overlap, every overlap once."""
    if len(a) == 1 or len(b) == 1:
        return [x + y for x in a for y in b]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append(a[i] + b[j])
        step = ends_a[i] - ends_b[j]
        i, j = i + (step <= 0), j + (step >= 0)
    return out


class Aligner:
    """Aligned texts, chunk by chunk; ``width`` is the number of ids of the second tokenizer.

    What is known of a chunk: n_a, n_b, n_groups, its groups as text, its links as bytes; None where the
    tokens of either tokenizer don't spell it.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.width = len(self.b.bytes)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def aligned(self, chunks: list[str]) -> list[tuple | None]:
        """Chunks as one text after the other, so that each offset is looked up once for all."""
        a, b = self.a.encode_all(chunks), self.b.encode_all(chunks)
        data = [c.encode() for c in chunks]
        whole = b"".join(data)
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return [None] if len(chunks) == 1 else [x for c in chunks for x in self.aligned([c])]
        said_a, said_b, wide = list(map(str, a)), list(map(str, b)), [i * self.width for i in a]
        ends_a, ends_b = ends(a, self.a.bytes), ends(b, self.b.bytes)
        out, bounds = [], itertools.accumulate(map(len, data))
        bound, from_a, from_b, lo_a, lo_b, groups, pairs = next(bounds), 0, 0, 0, 0, [], []
        for end, hi_a, hi_b in common_cuts(ends_a, ends_b):
            if hi_a - lo_a == 1 and hi_b - lo_b == 1:
                groups.append(f"{said_a[lo_a]}|{said_b[lo_b]}")
                pairs.append(wide[lo_a] + b[lo_b])
            else:
                groups.append(f"{','.join(said_a[lo_a:hi_a])}|{','.join(said_b[lo_b:hi_b])}")
                pairs += links(wide[lo_a:hi_a], ends_a[lo_a:hi_a], b[lo_b:hi_b], ends_b[lo_b:hi_b])
            lo_a, lo_b = hi_a, hi_b
            if end >= bound:
                if end > bound:  # a token across the end of a chunk
                    return [None] if len(chunks) == 1 else [x for c in chunks for x in self.aligned([c])]
                out.append((hi_a - from_a, hi_b - from_b, len(groups), ";".join(groups), array("q", pairs).tobytes()))
                bound, from_a, from_b, groups, pairs = next(bounds, 0), hi_a, hi_b, [], []
        return out

    def chunks(self, texts: list[str]) -> list[list[tuple | None]]:
        """Per text what is known of its chunks, in order."""
        cut = [_CHUNK.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        own, older = self.known, self.older
        new = {c for some in cut for c in some if c not in own}
        again = {c: older[c] for c in new if c in older}
        own.update(again)
        new = [c for c in new if c not in again]
        short = [c for c in new if len(c) <= LONGEST]
        for at in range(0, len(short), 2000):
            some = short[at : at + 2000]
            own.update(zip(some, self.aligned(some), strict=True))
        long = {c: self.aligned([c])[0] for c in new if len(c) > LONGEST}
        return [[own[c] if c in own else long[c] for c in some] for some in cut] if long else [list(map(own.__getitem__, some)) for some in cut]

    def whole(self, text: str) -> tuple | None:
        """The same for a text as one chunk."""
        return self.aligned([text])[0]

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """A row of ``ALIGNED`` for each text; null, empty and misspelt ones have no tokens."""
        none = (0, 0, 0, 0, "", [], [])
        known = iter(self.chunks([" " + t for t in texts if t]))
        for t in texts:
            parts = next(known) if t else [None]
            if t and None in parts:
                parts = [self.whole(" " + t)]
            if None in parts:
                yield none
                continue
            n_a, n_b, n_groups, said, links = zip(*parts, strict=True)
            pairs, times = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), hashlib.sha256(";".join(said).encode()).hexdigest(), pairs, times.astype(np.int32)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ALIGNED`` for every row of ``docs``: the distinct links of a text as numbers (first id times the
    size of the second vocabulary, plus second id), and how often it holds each."""

    def run(batches: Iterator[pd.DataFrame]):
        aligner = _ALIGNERS.setdefault((byte_path, piece_path), None) or Aligner(byte_path, piece_path)
        _ALIGNERS[byte_path, piece_path] = aligner
        for f in batches:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                rows = list(aligner.texts([None if t is None or t is pd.NA else t for t in part["text"]]))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id long, {ALIGNED}")


def pair_counts(texts: DataFrame, width: int) -> DataFrame:
    """pair, count, best: in how many rows of ``texts`` a pair is linked, and whether no pair of its first id is
    in more. Counts are added up inside the tasks before anything is shuffled."""
    counts = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    first = F.floor(F.col("pair") / width)
    most = written(counts, "align-counts")
    top = most.groupBy(first.alias("a")).agg(F.max("count").alias("top"))
    return most.join(top, first == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def with_counts(texts: DataFrame, counts: DataFrame, sent: int = SENT_PAIRS) -> DataFrame:
    """``texts`` with n_best and count_sum in place of pairs and times. Both are written tables.

    The most frequent pairs, ``sent`` at most, go to every task: all of them, or those in more than
    one in ``sent`` of all links. Links of the other pairs are joined by a shuffle, in which a key
    then has no more than that share of the rows.
    """
    spark = texts.sparkSession
    n, links = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    least = 0 if n <= sent else links // sent + 1
    often = counts.where(F.col("count") >= least).toArrow().sort_by("pair")
    table_ = spark.sparkContext.broadcast(tuple(often[c].to_numpy() for c in ("pair", "count", "best")))

    def run(batches: Iterator[pd.DataFrame]):
        keys, count, best = table_.value
        for f in batches:
            sums, tops, rest, again = [], [], [], []
            for pairs, times in zip(f.pop("pairs"), f.pop("times"), strict=True):
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                at, t = at[known], times[known].astype(np.int64)
                sums.append(int((count[at] * t).sum()))
                tops.append(int(t[best[at]].sum()))
                rest.append(pairs[~known])
                again.append(times[~known])
            yield f.assign(count_sum=sums, n_best=tops, pairs=rest, times=again)

    part = texts.mapInPandas(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, count_sum long, n_best long, pairs array<long>, times array<int>")
    if least == 0:
        return part.drop("pairs", "times", "row")
    part = written(part, "align-part")
    links_ = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("t"))
    seldom = links_.join(counts.where(F.col("count") < least), "pair").groupBy("row").agg(F.sum(F.col("count") * F.col("t")).alias("more"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = part.drop("pairs", "times").join(seldom, "row", "left")
    return joined.withColumn("count_sum", F.col("count_sum") + zero("more")).withColumn("n_best", F.col("n_best") + zero("more_best")).drop("more", "more_best", "row")


def alignment(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    A text that is null or empty, or that the tokens of either tokenizer don't spell (a letter
    U+2581, say), has no tokens: zeros and an empty string. Repeated rows count as documents each,
    null ids stay null, an empty table gives an empty result, further columns are ignored. Paths are
    those of the vocabulary files.
    """
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path, piece_path = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=piece_path).get_piece_size()
    texts = written(aligned_texts(docs, byte_path, piece_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "align-texts")
    counts = written(pair_counts(texts, width), "align-pairs")
    return with_counts(texts, counts, sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
