"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts each text into chunks, so equal passages give equal
chunks wherever they stand. A chunk met before is not encoded again. A cut may fall inside a
word, so a chunk is kept as its head (up to the first break), its inner part and its tail (from the
last break); the tail, the next head and any chunk without a break between them are joined and
encoded again as one piece: that is where the token sequence depends on both sides.

A break is a blank or line feed. The tokenizers this serves normalise white space to single blanks
and split words there. Every join is encoded once more with a word of the chunk on either side, all
joins of a part at once; where the tokens don't agree with those of joins and chunks, the part is
encoded whole, the widest join there is. Coder.agrees() refuses tokenizers that would end there always.

Within an inner part pieces between breaks are looked up in the same way. Both memories belong to the
Python worker, live across its tasks and forget what wasn't asked for lately once they hold PIECE_BYTES
and CHUNK_BYTES (twice that at most), and long texts are encoded in parts, so a worker needs about
100 MB beyond the tokenizer, whatever the input; only a stretch without breaks is held whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.common import prepare

WINDOW = 16
#: A byte ends a chunk with probability 2**-MASK_BITS; bytes within MIN_CHUNK of the last cut don't.
MASK_BITS, MIN_CHUNK = 8, 64
#: Bytes of a generation of a worker's two memories, and the longest remembered piece and chunk in bytes.
PIECE_BYTES, CHUNK_BYTES, LONG_PIECE, LONG_CHUNK = 24 << 20, 8 << 20, 64, 4096
#: Characters encoded at once, and bytes of unknown pieces that the library is given at once.
PART, LEARN_BYTES = 1 << 18, 1 << 16

_BREAK = re.compile("[ \n]")
#: Letters from A to ÿ in UTF-8: they stay one word each, whatever is normalised.
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)


def cuts(data: bytes) -> list[int]:
    """Ends of chunks, the text's end last. They depend on nearby bytes only, and never split a character."""
    a = np.frombuffer(data, np.uint8)
    out: list[int] = []
    if len(a) > MIN_CHUNK:
        h, x, w = _TABLE[a], None, 1
        while w < WINDOW:  # h covers w bytes that end here; doubled until it covers WINDOW
            x = h.copy()
            x[w:] += h[:-w] * _MULT
            h, w = x, 2 * w
        ends = np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1
        last = 0
        for e in ends.tolist():
            if e - last >= MIN_CHUNK and e < len(a) and a[e] & 0xC0 != 0x80:
                out.append(e)
                last = e
    return [*out, len(a)]


class Memory:
    """A dictionary in two generations, each of at most `most` bytes by estimate: what is asked for again moves to the
    younger, and when that is full the older one is dropped. Keys and values are bytes, or tuples of bytes."""

    #: What an entry takes besides its bytes: two objects and a place in a dictionary.
    ENTRY = 220

    def __init__(self, most: int):
        self.most, self.size, self.new, self.old = most, 0, {}, {}

    def known(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """What it holds of the wanted keys."""
        new, old = self.new, self.old
        out = {p: new[p] for p in wanted & new.keys()}
        if again := {p: old[p] for p in (wanted - out.keys()) & old.keys()}:
            self.add(again)
            out.update(again)
        return out

    def add(self, entries: dict) -> None:
        size = self.ENTRY * len(entries) + sum(map(len, entries))
        size += sum(map(len, entries.values())) if isinstance(next(iter(entries.values()), b""), bytes) else sum(60 * len(v) + sum(map(len, v)) for v in entries.values())
        if self.size + size > self.most and self.new:
            self.size, self.new, self.old = 0, {}, self.new
        self.size += size
        self.new.update(entries)


def spaced(data: bytes) -> bytes:
    """data with breaks as blanks, ASCII letters in lower case, and a blank where ASCII punctuation follows an ASCII
    or Latin-1 letter: the tokens are the same (Coder checks that), and far fewer pieces differ. Special tokens stay as they are, and
    so do letters before a byte that isn't ASCII: the tokenizer composes letters with marks before it lowers them."""
    data = data.replace(b"\n", b" ")
    if b"<|" in data:
        return data
    a = np.frombuffer(data.lower(), np.uint8)
    kind = _KIND[a]
    latin = np.flatnonzero(a[:-1] == 0xC3) + 1  # the second byte of a letter from À to ÿ
    kind[latin] = (a[latin] != 0x97) & (a[latin] != 0xB7)
    before = np.flatnonzero(a[1:] >= 0x80)
    if len(before):
        a = a.copy()
        a[before] = np.frombuffer(data, np.uint8)[before]
    return np.insert(a, np.flatnonzero(kind[:-1] + kind[1:] * 2 == 5) + 1, 32).tobytes() if len(a) else b""


#: 1: letters, 2: punctuation, 0: all else.
_KIND = np.array([1 if 97 <= c <= 122 else 2 if 33 <= c <= 47 or 58 <= c <= 96 or 123 <= c <= 126 else 0 for c in range(256)], np.uint8)


class Coder:
    """A tokenizer with memories of pieces and chunks; ids are kept packed, as bytes of int32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces, self.chunks = Memory(PIECE_BYTES), Memory(CHUNK_BYTES)
        self.widened = 0
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        size = max(vocab.values()) + 1
        self.listed = np.array([b"%d " % i for i in range(size)])  # what an id adds to the list of ids
        self.listed = self.listed.view(np.uint8).reshape(size, -1)
        self.ends_word = np.zeros(size, bool)
        self.suffixed = bool(suffix)
        if suffix:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        if self.tokenizer.decoder is not None or not self.agrees():
            raise ValueError("chunk reuse needs a tokenizer whose words end at blanks and that decodes by joining tokens with blanks")

    def agrees(self) -> bool:
        """Whether tokens at a break are the same when the sides are encoded apart, and spaced() changes none."""
        probes = ["a", "Word", "x.", "x..!", "it's", "o'clock'", "'s", "1", "é", "É.", "\u0301", "ß!", "÷.", "e\u0301.", "<|", "日本", "WORD.", "I\u0307\u0338", "aI\u0307.", "S\u0323\u0307"]
        of = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        one = {p: of(p) for p in probes}
        pairs = [(a, b, s) for a in probes for b in probes for s in (" ", "\n")]
        return all(of(f"{a}{s}{b}") == one[a] + one[b] == of(spaced(f"{a}{s}{b}".encode()).decode()) for a, b, s in pairs)

    def learn(self, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each piece and its ids. Many are encoded at once, joined by breaks. Of pieces that are one word of Latin letters
        each, the tokens that end words tell whose a token is; of others, and where that count is off, offsets do."""
        words, rest, at = [], [], 0
        for p in new:
            (words if self.suffixed and _WORD.fullmatch(p) else rest).append(p)
        while at < len(words):
            part, size = [], 0
            while at < len(words) and size < LEARN_BYTES:
                part.append(words[at])
                size += len(words[at])
                at += 1
            ids = self.quick([b"\n".join(part)])[0]
            edge = np.flatnonzero(self.ends_word[ids]) + 1
            if len(edge) != len(part) or edge[-1] != len(ids):
                rest += part
                continue
            data, a = ids.tobytes(), 0
            for p, b in zip(part, (4 * edge).tolist()):
                yield p, data[a:b]
                a = b
        yield from self.by_offsets(rest)

    def quick(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without offsets."""
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def by_offsets(self, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """As learn(), for any pieces."""
        at = 0
        while at < len(new):
            part, size = [], 0
            while at < len(new) and size < LEARN_BYTES:
                part.append(new[at])
                size += len(new[at])
                at += 1
            text = b"\n".join(part).decode()
            starts = np.cumsum([0] + [len(t) + 1 for t in text.split("\n")])
            e = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(e.ids, np.int32)
            edge = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), starts)
            data, edge = ids.tobytes(), (4 * edge).tolist()
            for p, a, b in zip(part, edge, edge[1:]):
                yield p, data[a:b]

    def look_up(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all wanted pieces, from the memory or encoded now; long ones and those of several words aren't kept."""
        several = [p for p in wanted if b" " in p]
        single = wanted.difference(several)
        out = self.pieces.known(single)
        got = dict(self.learn(list(single - out.keys())))
        for some in batched(((p, ids) for p, ids in got.items() if len(p) <= LONG_PIECE), 5000):
            self.pieces.add(dict(some))
        out.update(zip(several, [ids.tobytes() for ids in self.quick(several)]))
        out.update(got)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plans: list[list] = []
        fresh: dict[bytes, tuple] = {}
        wanted: set[bytes] = set()
        datas = [spaced(t.encode()) for t in texts]
        for data in datas:
            plan: list = []  # chunks as tuples, joins between them as bytes
            pending = b""
            ends = cuts(data)
            chunks = [data[i:j] for i, j in zip([0, *ends], ends)]
            held = self.chunks.known(set(chunks))
            for c in chunks:
                known = held.get(c) or fresh.get(c)
                if known is None:
                    head, *inner = c.split(b" ")
                    tail = inner.pop() if inner else None
                    if b"" in inner:
                        inner = [p for p in inner if p]
                    wanted.update(inner)
                    known = fresh[c] = (head, inner, tail)
                if known[-1] is None:
                    pending += known[0]
                    continue
                plan += (pending + known[0], known)
                pending = known[-1]
            plan.append(pending)
            plans.append(plan)
        sides = lambda k: (k[1][0], k[1][-1]) if len(k) == 3 and k[1] else k[2:4] if len(k) > 3 else (b"", b"")
        windows = []  # of each text: what stands left of a join, the join, what stands right of it
        for plan in plans:
            around = [(sides(plan[i - 1])[1] if i else b"", plan[i], sides(plan[i + 1])[0] if i + 1 < len(plan) else b"") for i in range(0, len(plan), 2)]
            windows.append([w for w in around if w[1]])
            for w in windows[-1]:
                wanted.update(w)
        seams = [b" ".join([p for w in joins for p in w if p]) for joins in windows]  # a text's joins with what stands around them
        wanted.update(seams)
        wanted.discard(b"")
        ids = self.look_up(wanted)
        made: dict[int, bytes] = {}
        for c, known in fresh.items():
            head, inner, tail = known
            made[id(known)] = middle = b"".join([ids[p] for p in inner])
            if tail is not None and len(c) <= LONG_CHUNK:
                self.chunks.add({c: (head, middle, *((inner[0], inner[-1]) if inner else (b"", b"")), tail)})
        out = []
        for data, plan, joins, seam in zip(datas, plans, windows, seams):
            if ids.get(seam, b"") == b"".join([ids[p] for w in joins for p in w if p]):
                parts = [(ids[p] if p else b"") if isinstance(p, bytes) else made[id(p)] if id(p) in made else p[1] for p in plan]
                out.append(np.frombuffer(b"".join(parts), np.int32))
            else:  # a join whose tokens don't agree with its neighbours': widened as far as it goes
                self.widened += 1
                out.append(np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, np.int32))
        return out

    def rows(self, texts: list[str]) -> list[tuple[np.ndarray, str, str]]:
        """ids, and SHA-256 of the ids as text and of their decoded text, of each text.

        Texts are encoded in parts of about PART characters that end at breaks, so that what is held at once besides the
        ids doesn't grow with a text; only a stretch without breaks is never cut.
        """
        out: list[tuple[np.ndarray, str, str]] = []
        run: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            out.extend(self.digests([ids]) for ids in self.encode(run))
            run.clear()
            size = 0

        for t in texts:
            if len(t) > 2 * PART:
                flush()
                out.append(self.digests(self.encode([p])[0] for p in parts(t)))
                continue
            run.append(t)
            size += len(t)
            if size >= PART:
                flush()
        flush()
        return out

    def digests(self, pieces: Iterable[np.ndarray]) -> tuple[np.ndarray, str, str]:
        """The pieces' ids as one array, and the two digests."""
        got, line, text = [], hashlib.sha256(), hashlib.sha256()
        for ids in pieces:
            if not len(ids):
                continue
            if got:
                line.update(b" ")
                text.update(b" ")
            got.append(ids)
            digits = self.listed[ids].ravel()
            line.update(digits[digits > 0][:-1])
            text.update(self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode())
        return np.concatenate(got) if got else np.empty(0, np.int32), line.hexdigest(), text.hexdigest()


def parts(text: str) -> Iterator[str]:
    """The text in parts of PART characters or more, each up to a break; the breaks between parts are left out."""
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at + PART)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end + 1


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, and ids (array<int>) if keep_ids.

    ids: as the tokenizers library's encode(text, add_special_tokens=False) without truncation and
    padding; special tokens' strings in a text count as the tokenizer file says. decoded: as
    decode(ids, skip_special_tokens=False). Null text: like an empty one, no tokens. Rows are
    independent; null ids stay, repeated rows repeat, other columns are left out.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer_path)
        for b in batches:
            at = 0
            while at < b.num_rows:  # a part of the batch at a time, so that few texts are held as Python objects
                n, size = 0, 0
                while at + n < b.num_rows and size < PART:
                    size += len(b.column(1)[at + n].as_buffer() or b"") if b.column(1)[at + n].is_valid else 0
                    n += 1
                part = b.slice(at, n)
                at += n
                ids, lines, texts = zip(*c.rows([t or "" for t in part.column(1).to_pylist()]))
                edges = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ids), pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(lines), pa.array(texts), *flat], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded: the tokenizer's decode(ids, skip_special_tokens=False); null ids give null."""
    prepare(rows.sparkSession)

    @F.pandas_udf("string")
    def text_of(column):
        t = coder(tokenizer_path).tokenizer
        return column.map(lambda x: None if x is None else t.decode([int(i) for i in x], skip_special_tokens=False))

    return rows.withColumn("decoded", text_of(F.col(ids_col)))
