"""Operator 10: byte-pair encoding by a compiled tokenization automaton, and decoding.

The merges are compiled into a deterministic automaton over tokens whose paths are the right encodings and no
others.  It begins with one state and a loop per base symbol; each merge ``u v -> w`` then adds one gadget:

* ``w`` may come wherever ``u`` may come (its incoming arcs copy those of ``u``),
* after ``w`` the automaton stands where it stood after ``v`` (the state of ``w`` copies that of ``v``),
* the arc ``u`` then ``v`` goes (that pair is always merged now).

So the state after a token is given by the token, and whether the arc ``a`` then ``b`` exists follows from
replaying the gadgets that made ``a`` and ``b``, newest first.  Rows of this 49k x 49k arc table are filled on
first use; the automaton that reads the characters (all tokens, with suffix arcs) is a second transition table.
Reading keeps, for every prefix of a word, the one last token whose arc exists; walking back gives the word's path.  The new
words of a batch are read together, a symbol of all of them at a time, by look-ups in arrays.  Decoding emits the arc labels.
Words met before are looked up with the bytes of their ids, so a repeated word costs one look-up; decimal ids and labels are joined
for a run of texts at once.  Arcs asked for lately are kept by their pair of tokens.

Null texts count as empty; empty texts have no ids.  Columns of the names that are added are replaced if the table
has them already.  Rows never depend on each other: no shuffle, and repeated rows, ties and skew cost nothing extra.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .arrays import runs, texts
from .rows import extend

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Entries of a generation: a worker keeps two of them of words already encoded.
MEMO = 60_000
#: Words of up to so many bytes are read together, so many at a time.
TOGETHER, SLICE = 256, 5_000
#: Lower-case texts of these characters only are in normal form, and the standard library's patterns agree on them with the vocabulary's library.
LATIN = "a-zß-öø-ÿĀ-ſ"
PLAIN = re.compile(f"[\x00-\x7f{LATIN}–—’“”«»¿¡…]*")
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
FINAL = 256
#: Places (a power of two) for arcs asked for lately.
ARCS = 17


# Letters and numbers that the pattern library here knows, but the vocabulary's library (an older
# version of the character standard) takes for signs.  First and last of each range.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Memo:
    """The entries asked for lately: two generations, so that frequent ones survive when room is made.  ``make`` gives the entries of a list of keys."""

    def __init__(self, make, size: int = MEMO):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, keys: list) -> list:
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        holes = [i for i, e in enumerate(out) if e is None]
        missing = dict.fromkeys([keys[i] for i in holes])
        found = dict(zip(missing, map(self.old.get, missing)))
        new = [k for k, e in found.items() if e is None]
        found.update(zip(new, self.make(new)))
        if len(self.young) + len(found) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(found)
        for i in holes:
            out[i] = found[keys[i]]
        return out


class Automaton:
    def __init__(self, spec: str):
        t = json.loads(spec)
        model, self.labels = t["model"], {}
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        byte_of = {c: b for b, c in enumerate(_byte_names())}
        self.labels = {i: s for s, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.labels.update({i: s for s, i in self.special.items()})
        pattern = next(p["pattern"]["Regex"] for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.plain = re.compile(pattern.replace("\\p{L}", LATIN).replace("\\p{N}", "0-9").replace("\\s", WHITE))
        pattern = pattern.replace("\\s", WHITE)
        self.piece = regex.compile(pattern)
        newer = [tuple(int(x, 16) for x in r.split("-")) for r in NEWER.split()]
        self.first_newer = chr(newer[0][0])
        self.newer = regex.compile("[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in newer) + "]")
        for known in ("\\p{L}", "\\p{N}"):
            pattern = pattern.replace(known, f"[{known}--{self.newer.pattern}]")
        self.piece_newer = regex.compile(f"(?V1){pattern}")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # gadgets: the merge that made each token, and its place in the order
        self.order, self.parts, self.pair = {}, {}, {}
        for k, m in enumerate(model["merges"]):
            u, v = m if isinstance(m, list) else m.split(" ")
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if w in self.order:
                raise ValueError(f"two merges make {u + v!r}")
            self.order[w], self.parts[w] = k, (a, b)
            self.pair[a << 20 | b] = k
        # the reading automaton: a state per prefix of a token, arcs by symbol, longest known suffix on a miss
        self.arcs: dict[int, int] = {}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.back, self.depth = [0], [0]
        own = {0: None}
        tree: list[list[int]] = [[]]
        for s, i in vocab.items():
            if i not in self.order and len(s.removesuffix(suffix) if suffix else s) != 1 and s not in byte_of:
                continue
            body = s[:-len(suffix)] if suffix and s.endswith(suffix) and len(s) > len(suffix) else s
            symbols = [byte_of[c] for c in body]
            if body is not s:
                symbols[-1] += FINAL
            at = 0
            for x in symbols:
                to = self.arcs.get(at << 9 | x)
                if to is None:
                    to = self.arcs[at << 9 | x] = len(tree)
                    tree[at].append(x)
                    tree.append([])
                    self.back.append(0)
                    self.depth.append(self.depth[at] + 1)
                    self.ends.append(())
                at = to
            own[at] = (i, len(symbols))
        level = [0]
        while level:  # breadth first, so that a state's shorter suffixes are ready
            below = []
            for at in level:
                for x in tree[at]:
                    to = self.arcs[at << 9 | x]
                    f = self.back[at]
                    while at and f and (f << 9 | x) not in self.arcs:
                        f = self.back[f]
                    back = self.arcs.get(f << 9 | x, 0) if at else 0
                    self.back[to] = back
                    self.ends[to] = ((own[to],) if own.get(to) else ()) + self.ends[back]
                    below.append(to)
            level = below
        self.decimal_texts = pa.array([str(i) for i in range(len(self.labels))], pa.large_string())
        self.label_texts = pa.array([self.labels[i] for i in range(len(self.labels))], pa.large_string())
        self.known = Memo(self._entries)
        self.asked, self.answer = np.full(1 << ARCS, -1, np.int64), np.zeros(1 << ARCS, bool)
        self._tables(len(self.labels))
        self._forget()

    def _tables(self, size: int) -> None:
        """The automata as arrays: merges by pair, parts of tokens, arcs by state and symbol, tokens that end in a state, longest first."""
        self.pairs = np.array(sorted(self.pair), np.int64)
        self.ranks = np.array([self.pair[k] for k in self.pairs.tolist()], np.int32)
        self.made, self.left, self.right = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for token, k in self.order.items():
            self.made[token], (self.left[token], self.right[token]) = k, self.parts[token]
        self.keys = np.array(sorted(self.arcs), np.int64)
        self.targets = np.array([self.arcs[k] for k in self.keys.tolist()], np.int32)
        state, symbol = self.keys >> 9, self.keys & 511
        self.bits = np.zeros((len(self.back), 8), np.uint64)
        np.bitwise_or.at(self.bits, (state, symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
        self.offset = np.searchsorted(self.keys, (np.arange(len(self.back))[:, None] << 9) + (np.arange(8) << 6)).astype(np.int32)
        self.behind = np.array(self.back, np.int32)
        self.begin = np.concatenate([[0], np.cumsum([len(e) for e in self.ends])])
        self.token, self.length = (np.array([e[i] for own in self.ends for e in own], np.int32) for i in (0, 1))

    def _forget(self) -> None:
        """The dictionaries behind the arrays go: they are needed for very long words alone."""
        self.order = self.parts = self.pair = self.arcs = self.ends = self.back = None

    def _remember(self) -> None:
        made = np.flatnonzero(self.made >= 0)
        self.order = dict(zip(made.tolist(), self.made[made].tolist()))
        self.parts = dict(zip(made.tolist(), zip(self.left[made].tolist(), self.right[made].tolist())))
        self.pair = dict(zip(self.pairs.tolist(), self.ranks.tolist()))
        self.arcs = dict(zip(self.keys.tolist(), self.targets.tolist()))
        self.back = self.behind.tolist()
        every = list(zip(self.token.tolist(), self.length.tolist()))
        self.ends = [tuple(every[a:b]) for a, b in zip(self.begin.tolist(), self.begin[1:].tolist())]

    def _next(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(at), np.int32), np.arange(len(at))
        while len(open_):
            place = self._place(at, x)
            hit = place >= 0
            out[open_[hit]] = place[hit]
            more = ~hit & (at > 0)
            open_, at, x = open_[more], self.behind[at[more]], x[more]
        return out

    def _place(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The state behind the arc ``x`` of each state, -1 without one: symbols of a state are looked up in its own row of bits."""
        word, bit = x >> 6, (x & 63).astype(np.uint64)
        bits = self.bits[at, word]
        before = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where((bits >> bit) & np.uint64(1), self.targets[np.minimum(self.offset[at, word] + before, len(self.targets) - 1)], -1)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_replay`` of many pairs at once; those asked for lately are looked up."""
        pair = a.astype(np.int64) << 20 | b
        place = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ARCS)).view(np.int64)
        out, new = self.answer[place], np.flatnonzero(self.asked[place] != pair)
        if len(new):
            out[new] = self._replay_many(pair[new])
            self.asked[place[new]] = pair[new]
            kept = new[self.asked[place[new]] == pair[new]]  # one of the pairs of a place
            self.answer[place[kept]] = out[kept]
        return out

    def _replay_many(self, pair: np.ndarray) -> np.ndarray:
        pair, back = np.unique(pair, return_inverse=True)
        a, b, out, open_ = pair >> 20, pair & 0xFFFFF, np.ones(len(pair), bool), np.arange(len(pair))
        when = np.full(len(pair), len(self.pairs), np.int64)
        while len(open_):
            key = a << 20 | b
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            gone = (self.pairs[place] == key) & (self.ranks[place] < when)
            out[open_[gone]] = False
            of_a, of_b = self.made[a], self.made[b]
            go = ~gone & ((of_a >= 0) | (of_b >= 0))
            a, b, of_a, of_b, when, open_ = a[go], b[go], of_a[go], of_b[go], when[go], open_[go]
            first, same = of_a >= of_b, a == b
            when = np.minimum(when, np.where(first, of_a, of_b + 1))
            a, b = np.where(first, self.right[a], a), np.where(first & ~same, b, np.where(first, self.left[a], self.left[b]))
        return out[back]

    def _read_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(np.frombuffer(x, np.int32).tolist()) for x in self._paths(words)]

    def _paths(self, words: list[bytes]) -> list[bytes]:
        """``_read`` of many words, symbol after symbol of all of them; the ids as bytes of 32-bit numbers."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        symbols = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8).astype(np.int16)
        start = np.cumsum(size) - size
        symbols[start + size - 1] += FINAL
        last, took = np.full((len(words), size[0] + 1), -1, np.int32), np.zeros((len(words), size[0] + 1), np.int32)
        at = np.zeros(len(words), np.int32)
        for i in range(size[0]):
            live = int(np.searchsorted(-size, -i))  # words of more than i symbols
            at = self._next(at[:live], symbols[start[:live] + i])
            open_, place = np.arange(live), self.begin[at]
            while len(open_):
                if (place[open_] >= self.begin[at[open_] + 1]).any():
                    raise ValueError("no path for a word")
                token, length = self.token[place[open_]], self.length[place[open_]]
                before = last[open_, i + 1 - length]
                good = before < 0
                if not good.all():
                    good[~good] = self._may_follow(before[~good], token[~good])
                last[open_[good], i + 1], took[open_[good], i + 1] = token[good], length[good]
                open_ = open_[~good]
                place[open_] += 1
        where, rest, columns = np.arange(len(words)), size.copy(), []
        while len(where):
            column = np.full(len(words), -1, np.int32)
            column[where] = last[where, rest]
            columns.append(column)
            rest = rest - took[where, rest]
            where, rest = where[rest > 0], rest[rest > 0]
        tokens = np.empty((len(words), len(columns)), np.int32)
        tokens[order] = np.array(columns[::-1]).T
        there = tokens >= 0
        flat, ends = tokens[there].tobytes(), np.cumsum(4 * there.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _replay(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if self.order is None:
            self._remember()
        when = len(self.order)  # gadgets before this one have been added
        while True:
            removed = self.pair.get(a << 20 | b)
            if removed is not None and removed < when:
                return False
            made_a, made_b = self.order.get(a, -1), self.order.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a >= made_b:  # the state of a was copied before its gadget removed an arc
                when = min(when, made_a)
                if a == b:
                    a, b = self.parts[a][1], self.parts[a][0]
                else:
                    a = self.parts[a][1]
            else:  # the arcs into b were copied after its gadget removed one
                when = min(when, made_b + 1)
                b = self.parts[b][0]

    def _read(self, data: bytes) -> tuple[int, ...]:
        """The path of one word, symbol by symbol."""
        if self.arcs is None:
            self._remember()
        arcs, back, ends = self.arcs, self.back, self.ends
        n = len(data)
        last, start = [0] * (n + 1), [0] * (n + 1)
        at = 0
        for i in range(n):
            x = data[i] if i < n - 1 else data[i] + FINAL
            while (to := arcs.get(at << 9 | x)) is None and at:
                at = back[at]
            at = to or 0
            for token, size in ends[at]:
                j = i + 1 - size
                if j == 0 or self._replay(last[j], token):
                    last[i + 1], start[i + 1] = token, j
                    break
            else:
                raise ValueError(f"no path for {data!r}")
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return tuple(out[::-1])

    def pieces(self, text: str) -> list[str]:
        """Normalised text cut into words, as the vocabulary file says."""
        folded = text.lower()
        if PLAIN.fullmatch(folded):
            return self.plain.findall(folded)
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if max(text) >= self.first_newer and self.newer.search(text):
            return self.piece_newer.findall(text)
        return self.piece.findall(text)

    def _entries(self, pieces: list[str]) -> list[bytes]:
        ids: dict[str, bytes] = {p: np.int32(self.special[p]).tobytes() for p in pieces if p in self.special}
        coded = [p.encode() for p in pieces]
        brief = sorted([i for i, p in enumerate(pieces) if p not in ids and len(coded[i]) <= TOGETHER], key=lambda i: len(coded[i]))
        for at in range(0, len(brief), SLICE):
            part = brief[at:at + SLICE]
            ids.update(zip([pieces[i] for i in part], self._paths([coded[i] for i in part])))
        out = [ids[p] if p in ids else np.array(self._read(w), np.int32).tobytes() for p, w in zip(pieces, coded)]
        if self.arcs is not None:
            self._forget()
        return out

    def cut_up(self, text: str) -> list[str]:
        """The pieces of a text in order; a special token is a piece."""
        if self.cut and "<" in text:
            parts = self.cut.split(text)
            if len(parts) > 1:
                return list(chain.from_iterable([part] if k % 2 else self.pieces(part) for k, part in enumerate(parts)))
        return self.pieces(text)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many there are before each text and at the end."""
        pieces = [self.cut_up(t) for t in texts]
        found = self.known(list(chain.from_iterable(pieces)))
        ends = list(accumulate(map(len, pieces)))
        rows = [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]
        return np.frombuffer(b"".join(rows), np.int32), np.cumsum([0, *[len(r) // 4 for r in rows]])

    def words(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str, str]]]:
        """(ids, ids in decimals, labels) of the pieces of each text, in order."""
        every = [[tuple(np.frombuffer(x, np.int32).tolist()) for x in self.known(self.cut_up(t))] for t in texts]
        return [[(x, " ".join(map(str, x)), self.decode(x)) for x in row] for row in every]

    def encode(self, text: str) -> list[int]:
        return self.ids([text])[0].tolist()

    def decode(self, ids) -> str:
        """The labels of the path, joined as a vocabulary without a decoder does."""
        return " ".join(map(self.labels.__getitem__, ids))


_compiled: dict[int, Automaton] = {}


def compiled(spec: str) -> Automaton:
    """One automaton per worker process."""
    key = hash(spec)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Automaton(spec)
    return _compiled[key]


#: What ``encode`` can add to a table.
ADDED = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def _joined(flat: np.ndarray, before: np.ndarray, names: pa.Array) -> pa.Array:
    """The names of the ids of each row, joined by blanks."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(before, pa.int64()), names.take(pa.array(flat))), pa.scalar(" ", names.type))


def _digests(joined: pa.Array) -> pa.Array:
    """SHA-256 of each text."""
    _, where, data = joined.buffers()
    offsets = np.frombuffer(where, np.int64)[joined.offset:joined.offset + len(joined) + 1].tolist()
    raw = memoryview(data) if data is not None else b""
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string())


def encode(df: DataFrame, path: str = PATH, text: str = "text", columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``df`` with the ``columns`` (of ``ADDED``) of every whole text: ids, their labels, how many ids, and the SHA-256 of the decimal ids and of the labels.

    ``path``: vocabulary file, read by the driver (its size is that of the vocabulary, not of the data)."""
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run():
        a = compiled(spec.value)

        make = {
            "ids": lambda flat, before: pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(flat)),
            "decoded": lambda flat, before: _joined(flat, before, a.label_texts).cast(pa.string()),
            "n_tokens": lambda flat, before: pa.array(np.diff(before), pa.int64()),
            "ids_sha256": lambda flat, before: _digests(_joined(flat, before, a.decimal_texts)),
            "decoded_sha256": lambda flat, before: _digests(_joined(flat, before, a.label_texts)),
        }

        def work(batch, place):
            column = texts(batch.column(place[text]))
            for at, end, _, _ in runs(column, 1 << 20):
                found = a.ids(column.slice(at, end - at).to_pylist())
                yield at, [make[c](*found) for c in columns]

        return work

    return extend(df, run, [T.StructField(c, ADDED[c]) for c in columns])


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), columns=DIGESTS).select("doc_id", *DIGESTS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Key, language, source and the ids of every document, with their digests."""
    return encode(docs.select("doc_id", "lang", "source", "text"), columns=("ids", *DIGESTS)).drop("text")
