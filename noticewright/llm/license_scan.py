"""Licence scan by conditional compression.

Candidate blocks are runs of sentences with a licence's words. Each is compressed alone and with
every template as a raw dictionary; the templates that save enough are compared with the block word
by word, those that save most first, and the one with the fewest differences is reported if they are few. If the whole block isn't
confirmed, windows of each template's own length are. What stands before and after a confirmed
wording is scanned again until nothing confirms.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_texts import CUES, TEMPLATES

#: How much of the block's size a template must save to be compared word by word, and the share of
#: the template's words that may be missing or changed.
LEAST_SAVED, MOST_DIFFERENT = 0.25, 0.2

FOUND = "doc_id long, start long, end long, license string, template string, saved double, missing long, added long, exact boolean"

_SENTENCE = re.compile(r"[^\n.!?;]*(?:[.!?;](?!\s|$)[^\n.!?;]*)*(?:[.!?;]+|\n|$)")
_CUE = re.compile(CUES)
_CLOSING = re.compile(r"[.!?;)\]\"']*")
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*|<\.\.\.>")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of sentences with a cue; two sentences without may stand between."""
    start = end = None
    gap = 0
    for m in _SENTENCE.finditer(text):
        if not m[0].strip():
            continue
        if _CUE.search(m[0]):
            if start is None:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
            end, gap = m.start() + len(m[0].rstrip()), 0
        elif start is not None:
            gap += 1
            if gap > 2:
                yield start, end
                start = None
    if start is not None:
        yield start, end


def _lower(text: str) -> str:
    """Lower case in which every character keeps its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def differences(template: list[str], block: list[str]) -> tuple[int, int, int, int]:
    """Words of the template that the block lacks, words that stand between its matched ones, and
    the first and (exclusive) last matched word of the block. What comes before and after them
    belongs to other wordings."""
    runs = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template), 0, 0, 0
    free = template.count("<...>")
    missing = len(template) - sum(m.size for m in runs) - free
    first, last = runs[0].b, runs[-1].b + runs[-1].size
    inside = last - first - sum(m.size for m in runs)
    return max(0, missing), max(0, inside - 8 * free), first, last


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard as z

        # Size alone matters here: checksums and the like would only add to both sides.
        how = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = z.ZstdCompressor(**how)
        self.templates = [(a, b, _WORD.findall(t.lower()), z.ZstdCompressor(dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **how)) for a, b, t in templates]

        self.counts = [Counter(w for w in t if w != "<...>") for _, _, t, _ in self.templates]

    def saved(self, data: bytes, c) -> float:
        return 1 - len(c.compress(data)) / len(self.plain.compress(data))

    def best(self, block: str):
        data, at = block.encode("utf-8", "surrogatepass"), list(_WORD.finditer(_lower(block)))
        words = [m[0] for m in at]
        alone = len(self.plain.compress(data))
        ranked = sorted(((1 - len(c.compress(data)) / alone, a, b, t) for a, b, t, c in self.templates), key=lambda x: (-x[0], x[1], x[2]))
        found = []
        for saved, name, kind, template in [x for x in ranked if x[0] >= LEAST_SAVED]:
            missing, added, first, last = differences(template, words)
            if last and missing + added <= MOST_DIFFERENT * len(template):
                found.append((missing + added, -len(template), name, kind, saved, missing, added, at[first].start(), at[last - 1].end()))
        return min(found, default=None)

    def window(self, block: str):
        """The wording that explains most words of ``block``, in windows that start at a sentence and
        have about the template's own length. The saving is that of the matched words' text."""
        at = list(_WORD.finditer(_lower(block)))
        words, starts = [m[0] for m in at], []
        for m in _SENTENCE.finditer(block):
            k = next((k for k in range(starts[-1] if starts else 0, len(at)) if at[k].start() >= m.start()), None)
            if k is not None and (not starts or k > starts[-1]):
                starts.append(k)
        whole, found = Counter(words), []
        for (name, kind, template, c), count in zip(self.templates, self.counts, strict=True):
            free = template.count("<...>")
            # Fewer shared words than this can't be confirmed, in whatever order they stand.
            need = len(template) - free - MOST_DIFFERENT * len(template)
            if sum((count & whole).values()) < need:
                continue
            for k in starts:
                for room in {len(template) + 8 * free, int(1.2 * len(template)) + 8 * free + 1}:
                    some = words[k : k + room]
                    if sum((count & Counter(some)).values()) < need:
                        continue
                    missing, added, first, last = differences(template, some)
                    if not last or missing + added > MOST_DIFFERENT * len(template):
                        continue
                    lo, hi = at[k + first].start(), at[k + last - 1].end()
                    saved = self.saved(block[lo:hi].encode("utf-8", "surrogatepass"), c)
                    if saved >= LEAST_SAVED:
                        found.append((missing + added - len(template) + free, missing + added, name, kind, saved, missing, added, lo, hi))
        return min(found, default=None)

    def all(self, text: str, start: int, end: int) -> Iterator[tuple]:
        """(start, end, name, kind, saved, missing, added) of each wording in text[start:end]."""
        todo = [(start, end)]
        while todo:
            lo, hi = todo.pop()
            block = text[lo:hi]
            if not _CUE.search(block) or not (got := self.best(block) or self.window(block)):
                continue
            *_, name, kind, saved, missing, added, a, b = got
            b = lo + b + len(_CLOSING.match(block, b)[0])
            yield lo + a, b, name, kind, saved, missing, added
            todo += [(b, hi), (lo, lo + a)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed wording: doc_id, start and end (characters of the text),
    license, template, saved (share of its compressed size), missing and added words, exact.

    A block may hold any number of wordings. Null, empty and licence-free texts give no row, nor does an empty table. Rows are
    independent (repeated rows give repeated findings); a row without an id keeps its null id.
    """

    def run(frames: Iterator[pd.DataFrame]):
        scanner = Scanner()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                for start, end in blocks(text):
                    for a, b, name, kind, saved, missing, added in scanner.all(text, start, end):
                        rows.append((doc_id, a, b, name, kind, saved, missing, added, missing + added == 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"doc_id": "Int64", "exact": "bool"})

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CUES))
    return some.mapInPandas(run, FOUND)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
