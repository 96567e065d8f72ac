"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces
that continue one. Every node has a failure link and the number of pieces
that are complete when the link is taken (Aho-Corasick style, precomputed), so
greedy longest-match-first lengths come out in one pass over a word's
characters, without backing up and without building any piece. A word that
cannot be cut into pieces counts as one unknown token.

Only the distinct words of a slice of text are walked, all at once: step j
moves every word that has a j-th character, by one search in the sorted table
of transitions. Words of over ``LONG`` characters are walked one by one.

Defined cases: null text and text without words have no tokens; rows are
counted one by one, so repeated rows repeat; an empty vocabulary makes every
word unknown; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import split_words, table, text_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64
INITIAL, INNER, DEAD = 0, 1, -1


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that continue one) of a sentencepiece file; its word mark tells them apart."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p[0] == "▁" and len(p) > 1], [p for p in plain if p[0] != "▁"]


class Automaton:
    """keys (node << 21 | character, sorted) -> target; fail and pops per node."""

    def __init__(self, initial: list[str], inner: list[str]):
        go: list[dict[str, int]] = [{}, {}]
        accept = [False, False]
        for root, pieces in ((INITIAL, initial), (INNER, inner)):
            for piece in pieces:
                node = root
                for ch in piece:
                    nxt = go[node].get(ch)
                    if nxt is None:
                        nxt = go[node][ch] = len(go)
                        go.append({})
                        accept.append(False)
                    node = nxt
                accept[node] = accept[node] or node != root
        fail, pops = [DEAD] * len(go), [0] * len(go)
        todo = deque([INITIAL, INNER])
        while todo:  # parents first
            u = todo.popleft()
            for ch, v in go[u].items():
                if accept[v]:
                    fail[v], pops[v] = INNER, 1
                else:
                    z, n = fail[u], pops[u]
                    while z != DEAD and ch not in go[z]:
                        z, n = fail[z], n + pops[z]
                    if z != DEAD:
                        fail[v], pops[v] = go[z][ch], n
                todo.append(v)
        self.go, self.fail_list, self.pops_list = go, fail, pops
        pairs = sorted((u << 21 | ord(ch), v) for u, out in enumerate(go) for ch, v in out.items())
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.to = np.array([v for _, v in pairs] or [DEAD], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def walk(self, word: str) -> int:
        """Number of pieces of a word, 0 if it has no cut."""
        go, fail, pops = self.go, self.fail_list, self.pops_list
        u, n = INITIAL, 0
        for ch in word:
            while ch not in go[u]:
                n += pops[u]
                u = fail[u]
                if u == DEAD:
                    return 0
            u = go[u][ch]
        while u != INNER:
            n += pops[u]
            u = fail[u]
            if u == DEAD:
                return 0
        return n

    def _step(self, u: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = u << 21 | c
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.to[at], DEAD)

    def walk_all(self, words: pa.Array) -> np.ndarray:
        """``walk`` of every word (large strings)."""
        n_chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-n_chars, kind="stable")
        out = np.zeros(len(words), np.int64)
        first_short = int(np.searchsorted(-n_chars[order], -LONG))
        for i in order[:first_short]:
            out[i] = self.walk(words[int(i)].as_py())
        order = order[first_short:]
        if not len(order):
            return out
        short = words.take(pa.array(order))
        chars = np.frombuffer("".join(short.to_numpy(zero_copy_only=False)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = n_chars[order]
        start = np.cumsum(length) - length
        u, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for j in range(int(length[0])):
            live = int(np.searchsorted(-length, -j, side="left"))  # words with a j-th character come first
            todo = np.flatnonzero(u[:live] != DEAD)
            while len(todo):
                nxt = self._step(u[todo], chars[start[todo] + j])
                moved = nxt != DEAD
                u[todo[moved]] = nxt[moved]
                todo = todo[~moved]
                n[todo] += self.pops[u[todo]]
                u[todo] = self.fail[u[todo]]
                todo = todo[u[todo] != DEAD]
        todo = np.flatnonzero((u != INNER) & (u != DEAD))
        while len(todo):
            n[todo] += self.pops[u[todo]]
            u[todo] = self.fail[u[todo]]
            todo = todo[(u[todo] != INNER) & (u[todo] != DEAD)]
        out[order] = np.where(u == DEAD, 0, n)
        return out


def token_counts(docs: DataFrame, initial: list[str], inner: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row; an unknown word is one token."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(initial, inner))  # as large as the vocabulary
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])

    def count(batches):
        machine = sent.value
        for b in text_slices(batches, "text", 8 << 20):
            owner, codes, names = split_words(b.column("text"), lower=False)
            n = machine.walk_all(names) if len(names) else np.empty(0, np.int64)
            sums = (np.bincount(owner, x, minlength=b.num_rows).astype(np.int64) for x in (np.ones(len(codes)), np.maximum(n, 1)[codes], (n == 0)[codes]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, sums)], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), *read_vocabulary(VOCABULARY))
