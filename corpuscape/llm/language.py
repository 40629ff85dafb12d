"""Language by cross-parsing entropy: suffix automata of labelled text, one per language.

A text is read as lower-cased runs of letters with one space between, before and behind. Against the automaton of a
language its running text is cut greedily into the longest pieces that occur in that language's sample, across words where
the sample has the same words in a row; few pieces for its letters mean that the sample explains it well. The
language that needs the fewest pieces wins, ties by name. The score is the share of the second best among the pieces of the best
two: 0.5 is a tie, more is surer. Whole texts are cut, without a limit, as UTF-8: stretches of all texts of a batch are read in
lockstep, and a stretch is read again from the state before it until both readings meet, so the parse is the one of a single pass.

The sample is bounded in labelled rows, whose texts it holds whole: of each language the distinct texts with the smallest hash,
``SAMPLE_DOCS`` at most, until they have ``SAMPLE_CHARS`` characters. Texts above ``SAMPLE_ROW_CHARS`` come after all others, the
shortest first, so that a language that has only long ones still learns. Everything else covers all rows.

Null text, or one without a letter, is ``und`` with score 0. Rows with a null language teach nothing. Without
any labelled text all is ``und``. Repeated rows are scored alike. Other columns are left alone.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscape.llm.common import text_values

SAMPLE_DOCS = 200
SAMPLE_CHARS = 30_000
SAMPLE_ROW_CHARS = 4_000
#: Bytes of a text that are read in one go.
STRETCH = 512
#: Fewer stretches than this are read one by one.
FEW = 16
#: Stands between texts of a sample: no piece crosses it.
BORDER = "\n"
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def running_text(text: str | None) -> str:
    """Lower-cased runs of letters, one space between, before and behind; empty without a letter."""
    words = _LETTERS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


class SuffixAutomaton:
    """All substrings of a byte string; ``edges`` leads from a state and a byte to the next state."""

    def __init__(self, text: bytes):
        length, link = [0], [-1]
        edges: list[dict[int, int]] = [{}]
        last = 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    edges.append(dict(edges[q]))
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.edges = edges

    def steps(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """The greedy parse as a table: at ``place + symbol`` stands twice the next place, plus one where a piece begins.

        Place 0 is the state before any piece; no edge leads back to the automaton's first state, so its row is free. A byte
        that the text lacks is a piece of its own and leads to place 0."""
        begin = np.ones(width, np.int64)
        for c, to in self.edges[0].items():
            begin[symbols[c]] = 2 * width * to + 1
        table = np.tile(begin, (len(self.edges), 1))
        at = [(s, int(symbols[c]), 2 * width * to) for s, own in enumerate(self.edges) if s for c, to in own.items()]
        if at:
            rows, columns, values = np.array(at, np.int64).T
            table[rows, columns] = values
        # Samples are bounded: places fit 32 bits.
        return table.ravel().astype(np.int32 if table.max(initial=0) < 2**31 else np.int64)


class Stretches:
    """Symbols of several texts, cut into stretches."""

    def __init__(self, texts: list[bytes], symbols: np.ndarray):
        self.symbols = symbols[np.frombuffer(b"".join(texts), np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = -(-sizes // STRETCH)
        self.text = np.repeat(np.arange(len(texts)), parts)
        place = np.arange(len(self.text)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = place == 0
        self.start = (np.cumsum(sizes) - sizes)[self.text] + place * STRETCH
        self.size = np.minimum(sizes[self.text] - place * STRETCH, STRETCH)
        self.by_size = np.argsort(-self.size, kind="stable")

    def pieces(self, table: np.ndarray, n_texts: int) -> np.ndarray:
        """Pieces of each text."""
        count, last = self._alone(table)
        total, end = count.copy(), last.copy()
        todo = np.flatnonzero(~self.first)
        todo = todo[end[todo - 1] != 0]
        while len(todo):
            more, ends = self._from(table, todo, end[todo - 1], last[todo])
            total[todo] = count[todo] + more
            changed = todo[ends != end[todo]]
            end[todo] = ends
            after = changed[changed + 1 < len(self.first)] + 1
            todo = after[~self.first[after]]
        return np.bincount(self.text, total, n_texts).astype(np.int64)

    def _alone(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and last place of each stretch read from place 0."""
        start, size = self.start[self.by_size], self.size[self.by_size]
        place, count = np.zeros(len(start), table.dtype), np.zeros(len(start), table.dtype)
        # How many stretches reach each depth.
        open_at = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        for i in range(int(size[0]) if len(size) else 0):
            n = open_at[i]
            step = table[place[:n] + self.symbols[start[:n] + i]]
            count[:n] += step & 1
            place[:n] = step >> 1
        counts, places = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        counts[self.by_size], places[self.by_size] = count, place
        return counts, places

    def _from(self, table, which, before, last) -> tuple[np.ndarray, np.ndarray]:
        """How many more pieces the stretches ``which`` have when read from the places ``before`` in place of 0, and their last
        places. Both readings go on until they meet."""
        more, ends = np.zeros(len(which), np.int64), last.copy()
        own = np.arange(len(which))
        here, other = before.astype(np.int64), np.zeros(len(which), np.int64)
        start, size = self.start[which], self.size[which]
        for i in range(int(size.max())):
            if len(own) < FEW:
                for k in range(len(own)):
                    more[own[k]], ends[own[k]] = self._one(table, start[k] + i, size[k] - i, here[k], other[k], more[own[k]])
                break
            code = self.symbols[start + i]
            a, b = table[here + code], table[other + code]
            more[own] += (a & 1) - (b & 1).astype(np.int64)
            here, other = (a >> 1).astype(np.int64), (b >> 1).astype(np.int64)
            done = size == i + 1
            ends[own[done]] = here[done]
            go = ~done & (here != other)
            own, here, other, start, size = own[go], here[go], other[go], start[go], size[go]
        return more, ends

    def _one(self, table, start, size, here, other, more) -> tuple[int, int]:
        look = memoryview(table)
        here, other, more = int(here), int(other), int(more)
        rest = self.symbols[start : start + size].tolist()
        for at, code in enumerate(rest):
            a, b = look[here + code], look[other + code]
            more += (a & 1) - (b & 1)
            here, other = a >> 1, b >> 1
            if here == other:
                for code in rest[at + 1 :]:
                    here = look[here + code] >> 1
                break
        return more, here


class Model:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = [samples[n].encode() for n in self.names]
        used = np.unique(np.frombuffer(b"".join(texts), np.uint8))
        # Symbol 0 is any byte that no sample has. UTF-8 has fewer than 255 bytes.
        self.symbols = np.zeros(256, np.uint8)
        self.symbols[used] = np.arange(1, len(used) + 1)
        self.tables = [SuffixAutomaton(t).steps(self.symbols, len(used) + 1) for t in texts]

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Pieces per language and text."""
        cut = Stretches([t.encode() for t in texts], self.symbols)
        return np.array([cut.pieces(table, len(texts)) for table in self.tables], np.int64).reshape(len(self.names), len(texts))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        running = [running_text(t) for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for i, counts in enumerate(self.pieces(running).T.tolist()):
            if running[i] and self.names:
                order = sorted(zip(counts, self.names))
                langs[i] = order[0][1]
                scores[i] = order[1][0] / (order[0][0] + order[1][0]) if len(order) > 1 else 1.0
        return langs, scores


def samples(docs: DataFrame, taught: Column) -> dict[str, str]:
    """Bounded sample text per language from the rows of ``docs(doc_id, text, lang)`` for which ``taught`` holds.

    Copies are one text. Places are dealt by hash and length alone; texts move only for the chosen."""
    rows = docs.where(taught & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = rows.select("lang", "text", F.length("text").alias("size"), F.xxhash64("text").alias("draw"))
    long = F.when(F.col("size") > SAMPLE_ROW_CHARS, F.col("size")).otherwise(0)
    order = Window.partitionBy("lang").orderBy(long, "draw", "size")
    drawn = keyed.select("lang", "size", "draw").distinct().withColumn("place", F.row_number().over(order))
    drawn = drawn.where(F.col("place") <= SAMPLE_DOCS)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("place")) - F.col("size")
    drawn = drawn.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).drop("before")
    # SAMPLE_DOCS rows a language.
    texts = keyed.join(F.broadcast(drawn), ["lang", "size", "draw"]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r.lang, r.place)):
        out.setdefault(row.lang, []).append(running_text(row.text))
    return {lang: BORDER.join(own) for lang, own in out.items()}


PREDICTED = "struct<lang:string,score:double>"


#: The model a worker has built last, by the key of its samples: tasks of one worker share it.
_BUILT: dict[str, Model] = {}


def _model(key: str, shared) -> Model:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Model(shared.value)
    return _BUILT[key]


def _predictor(shared):
    key = uuid4().hex

    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = _model(key, shared).predict(text_values(texts))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict


def identify(docs: DataFrame, learned: dict[str, str], into: str) -> DataFrame:
    """``docs`` with a struct ``into`` of lang and score, predicted from the column text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    return docs.withColumn(into, F.arrow_udf(_predictor(shared), PREDICTED)(F.col("text")))
