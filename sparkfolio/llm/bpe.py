"""BPE by tree concatenation: halves of a long text are encoded in parallel and joined again, exactly.

A text is halved until the leaves are short. At each join a window of text around the cut is encoded
afresh and grows until it agrees with the left and with the right ids at a place where agreement is proof:

* at a change of character class after which the pre-tokenizer starts anew whatever came before (a letter
  or digit run that ends; a symbol run that ends at a digit or at white space), or
* inside one run of letters, digits or symbols, if the two tokens that meet there encode to themselves
  when put together. A sequence of BPE tokens whose neighbours all do so is the encoding of its text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, strings
from .tokens import encoder, tokenizer, vocabulary

#: Characters of a leaf; characters from which a document's leaves are spread over tasks.
LEAF, SPREAD = 8192, 65_536


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """Letter, Number, Space, Other; '?' for what Unicode versions may class differently."""
    k = unicodedata.category(c)
    if k == "Cn":
        return "?"
    if k[0] in "LN":
        return k[0]
    return "S" if c in "\x09\x0a\x0b\x0c\x0d\x20\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" or "\u2000" <= c <= "\u200a" else "O"


def _fresh(x: str, y: str) -> bool:
    """The pre-tokenizer always cuts between x and y and starts anew at y."""
    a, b = _kind(x), _kind(y)
    return "?" not in (a, b) and (a in "LN" and a != b or a == "O" and b in "NS")


class TreeEncoder:
    """Byte-level BPE vocabularies whose added tokens are plain strings."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.tok, self.leaf, self.leaves = tokenizer(path), leaf, encoder(path)
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        names = [self.tok.id_to_token(i) or "" for i in range(size)]
        # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        alphabet = {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}
        table = [n.encode() if n in self.added else bytes(alphabet[c] for c in n) for n in names]
        self.names, self.size = names, np.array([len(b) for b in table], np.int64)
        self.bytes, self.first = np.frombuffer(b"".join(table), np.uint8), np.cumsum(self.size) - self.size
        self._together = lru_cache(maxsize=1 << 16)(self._stay_apart)

    def _stay_apart(self, a: int, b: int) -> bool:
        return [t.id for t in self.tok.model.tokenize(self.names[a] + self.names[b])] == [a, b]

    def cut(self, text: str) -> list[str]:
        """Leaves of a text by repeated halving."""
        if len(text) <= self.leaf:
            return [text]
        return self.cut(text[: len(text) // 2]) + self.cut(text[len(text) // 2 :])

    def pieces(self, text: str) -> list[str | int]:
        """Leaves and, between them, the ids of added tokens that the text spells out."""
        out: list[str | int] = [text]
        for word, i in self.added.items():
            out = [y for x in out for y in ([x] if isinstance(x, int) else [z for k, s in enumerate(x.split(word)) for z in ([i] if k else []) + [s]])]
        return [y for x in out for y in ([x] if isinstance(x, int) else self.cut(x)) if y != ""]

    def _agreed(self, window: bytes, text: str, edges: np.ndarray, ids: np.ndarray, cut: int, own: np.ndarray, own_ids: np.ndarray, left: bool) -> tuple[int, int] | None:
        """Indexes, in the window's and the side's tokens, of the first token after an agreed boundary."""
        places = {int(p): k for k, p in enumerate(own)}
        order = range(len(edges) - 1, -1, -1) if left else range(len(edges))
        for j in order:
            p = int(edges[j])
            if (p >= cut if left else p <= cut) or not 0 < p < len(window) or p not in places or window[p] & 0xC0 == 0x80:
                continue
            i = places[p]
            x, y = window[:p].decode(errors="ignore")[-1:], window[p : p + 4].decode(errors="ignore")[:1]
            if not x or not y:
                continue
            if _fresh(x, y):
                return j, i
            if _kind(x) == _kind(y) != "?" and _kind(x) != "S":
                pair = (int(own_ids[i - 1]), int(ids[j])) if left else (int(ids[j - 1]), int(own_ids[i]))
                if (i > 0 if left else i < len(own_ids)) and self._together(*pair):
                    return j, i
        return None

    def join(self, a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        (ta, xa), (tb, xb) = a, b
        w = 32
        while True:
            la, lb = min(w, len(ta)), min(w, len(tb))
            text = ta[len(ta) - la :] + tb[:lb]
            window, cut = text.encode(), len(ta[len(ta) - la :].encode())
            ids = np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
            edges = np.concatenate([[0], np.cumsum(self.size[ids])])[: len(ids)]
            left, right = (0, 0) if la == len(ta) else None, (len(ids), len(xb)) if lb == len(tb) else None
            if left is None:
                tail = xa[max(0, len(xa) - cut - 1) :]
                own = cut - np.cumsum(self.size[tail][::-1])[::-1]
                if got := self._agreed(window, text, edges, ids, cut, own, tail, True):
                    left = got[0], len(xa) - len(tail) + got[1]
            if right is None:
                head = xb[: len(window) - cut + 1]
                own = cut + np.concatenate([[0], np.cumsum(self.size[head])])[: len(head)]
                right = self._agreed(window, text, edges, ids, cut, own, head, False)
            if left and right and left[0] <= right[0]:
                return ta + tb, np.concatenate([xa[: left[1]], ids[left[0] : right[0]], xb[right[1] :]])
            w *= 2

    def tree(self, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Joins neighbours, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0][1] if leaves else np.empty(0, np.int32)

    def whole(self, pieces: list[str | int], ids: list[np.ndarray | None]) -> np.ndarray:
        out: list[np.ndarray] = []
        run: list[tuple[str, np.ndarray]] = []
        for x, y in zip(pieces, ids):
            if isinstance(x, int):
                out, run = [*out, self.tree(run), np.array([x], np.int32)], []
            else:
                run.append((x, y))
        return np.concatenate([*out, self.tree(run)]).astype(np.int32)

    def encode_leaves(self, leaves: list[str]) -> list[np.ndarray]:
        flat, offsets = self.leaves.encode(pa.array(leaves, pa.string()))
        return [flat[a:b] for a, b in zip(offsets, offsets[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(t) for t in texts]
        done = iter(self.encode_leaves([x for p in cut for x in p if isinstance(x, str)]))
        return [self.whole(p, [None if isinstance(x, int) else next(done) for x in p]) for p in cut]

    def decode(self, ids: np.ndarray) -> str:
        n, ends = self.size[ids], np.cumsum(self.size[ids])
        at = np.repeat(self.first[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def tree_encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    return TreeEncoder(path, leaf)


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text: str = "text", leaf: int = LEAF, spread: int = SPREAD, round_trip: bool = False) -> DataFrame:
    """id and ids (array of int), one row per row of docs, whatever repeats; null and empty texts have no ids.
    round_trip adds `decoded`, what decode() gives for the ids, in the worker that has them already.
    Texts over `spread` characters become rows of leaves that are dealt to all tasks, encoded there, and
    joined by document; shorter ones are cut, encoded and joined where they are read."""
    path = vocabulary(vocab)
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    made = f"id {kind}, ids array<int>" + ", decoded string" * round_trip
    names = ["id", "ids", "decoded"][: 2 + round_trip]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree_encoder(path, leaf)
        for batch in batches:
            for part in slices(batch, 1):
                ids = t.encode(part.column(1).to_pylist())
                back = [pa.array(map(t.decode, ids), pa.string())] if round_trip else []
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(ids), *back], names)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree_encoder(path, leaf)
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(i, k, x if isinstance(x, str) else None, x if isinstance(x, int) else None) for i, s in enumerate(part.column(1).to_pylist()) for k, x in enumerate(t.pieces(s))]
                at, no, texts, added = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), part.column(2).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(texts, pa.string()), pa.array(added, pa.int32())], ["id", "row", "no", "text", "added"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree_encoder(path, leaf)
        for batch in batches:
            for part in slices(batch, 3):
                yield pa.RecordBatch.from_arrays([*part.columns, _id_lists(t.encode_leaves(strings(part.column(3)).to_pylist()))], [*part.schema.names, "ids"])

    def gather(pdf):  # the leaves of one document
        import pandas as pd

        pdf = pdf.sort_values("no")
        pieces = [x if isinstance(x, str) else int(y) for x, y in zip(pdf["text"], pdf["added"])]
        t = tree_encoder(path, leaf)
        ids = t.whole(pieces, [np.asarray(x, np.int32) for x in pdf["ids"]])
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "ids": [ids]} | ({"decoded": [t.decode(ids)]} if round_trip else {}))

    short = asked.where(F.length("text") <= spread).mapInArrow(here, made)
    far = asked.where(F.length("text") > spread).withColumn("row", F.monotonically_increasing_id())
    far = far.mapInArrow(scatter, f"id {kind}, row long, no int, text string, added int").repartition("row", "no")
    far = far.mapInArrow(leaves, f"id {kind}, row long, no int, text string, added int, ids array<int>")
    return short.unionByName(far.groupBy("row").applyInPandas(gather, made))


def decode(df: DataFrame, vocab: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df and the decoded text of its array of ids, added tokens included; a null array gives a null."""
    path, place = vocabulary(vocab), df.columns.index(ids)
    schema = df.withColumn(to, F.lit("x")).schema
    schema[to].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                col = part.column(place)
                flat, off = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
                made = [t.decode(flat[a:b]) if ok else None for a, b, ok in zip(off, off[1:], col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = encode(documents(spark, sf_dir), "byte_bpe_50k.json", round_trip=True)
    return x.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
