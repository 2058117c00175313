"""SentencePiece encoding and decoding by suffix-array matching, for a given BPE model with byte fallback.

Each slice of whole texts is cut at white space marks into words, and the distinct words not met before in this worker
are concatenated into one text. A suffix array over it (sorted by as many characters as the longest piece has) is
searched for every piece of the vocabulary by binary search; the ranges found are all the places where pieces occur.
These edges are sorted by their end and relaxed from left to right for all words at once: the BPE encoding of a prefix
ends with the one piece that leads there from a prefix whose own last piece is compatible with it. Two pieces are
compatible if no merge across their border would have come first, which is decided by undoing their merges, latest
first. So the result equals that of running the merges, without a queue. Characters without a piece become their bytes.

Words with a run of white space marks (whose merges are tied) or with characters for which relaxing leaves no single
answer are merged directly. The encodings of up to `memory` words are kept in each worker, which changes no result.

Decoding puts pieces and bytes together again and drops the mark in front. Cases: null and empty texts have no tokens;
the white space mark itself (U+2581) decodes to a space, as in the format; texts are never cut; repeated rows are
encoded each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.batches import map_texts
from quarry.llm.shared import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
FAR = np.int64(1) << 40


class Vocabulary:
    """Pieces, merges and the decoding table of a BPE model; bounded by the size of the vocabulary file."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.vocab_size()
        piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {piece[i]: i for i in normal}
        self.score = {i: sp.get_score(i) for i in normal}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a white space mark inside")
        # order of a merge: by score; single characters come from no merge
        multi = sorted((i for i in normal if len(piece[i]) > 1), key=lambda i: -self.score[i])
        self.order = np.full(n + 1, -1, np.int64)
        self.order[multi] = np.arange(len(multi))
        merges = [(self.ids[p[:k]] * (n + 1) + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        merges.sort()
        self.merge_key, self.merge_id = np.array([k for k, _ in merges], np.int64), np.array([i for _, i in merges], np.int64)
        # how each piece comes about; pieces that the merges never make are never used
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        usable = []
        for p, i in self.ids.items():
            last: list[tuple[int, int]] = []
            if self.merged(p, last) == [i]:
                usable.append(p)
                if last:
                    self.left[i], self.right[i] = last[-1]
        chars = sorted({c for p in usable for c in p})
        if len(chars) >= 1 << 15:
            raise ValueError("too many distinct characters for the packed keys")
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        code = {c: k + 1 for k, c in enumerate(chars)}
        self.longest = max(map(len, usable))
        self.piece_ids = np.array([self.ids[p] for p in usable], np.int64)
        self.piece_len = np.array([len(p) for p in usable], np.int64)
        self.parts = -(-self.longest // 4)
        low = np.zeros((len(usable), self.parts * 4), np.uint64)
        for k, p in enumerate(usable):
            low[k, : len(p)] = [code[c] for c in p]
        high = np.where(np.arange(low.shape[1])[None, :] < self.piece_len[:, None], low, np.uint64(0xFFFF))
        self.low, self.high = self.pack(low), self.pack(high)
        out = [piece[i].replace(MARK, " ").encode() if i in self.score else b"" for i in range(n)]
        for b, i in enumerate(self.bytes):
            out[i] = bytes([b])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len

    @staticmethod
    def pack(codes: np.ndarray) -> list[np.ndarray]:
        """Columns of four 16-bit codes each as one sortable number."""
        return [(codes[:, k] << np.uint64(48)) | (codes[:, k + 1] << np.uint64(32)) | (codes[:, k + 2] << np.uint64(16)) | codes[:, k + 3] for k in range(0, codes.shape[1], 4)]

    def merged(self, word: str, last: list | None = None) -> list[int]:
        """The merges run one by one: best score first, then leftmost. Unknown characters are -1 - code point."""
        n = len(word)
        text: list[str | None] = list(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            j = after[k]
            if j < n and text[k] in self.ids and text[j] in self.ids and (i := self.ids.get(text[k] + text[j])) is not None:
                heapq.heappush(heap, (-self.score[i], k, text[k] + text[j]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            j = after[k] if text[k] is not None else n
            if j >= n or text[k] + text[j] != both:
                continue  # one of the two has been merged otherwise since
            if last is not None:
                last.append((self.ids[text[k]], self.ids[text[j]]))
            text[k], text[j], after[k] = both, None, after[j]
            if after[k] < n:
                before[after[k]] = k
                offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [self.ids.get(t, -1 - ord(t[0])) for t in text if t is not None]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a: no merge across the border comes before the merges that made them."""
        ok = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), FAR)
        a, b = a.copy(), b.copy()
        while len(at):
            key = a * (self.n + 1) + b
            k = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            bad = (self.merge_key[k] == key) & (self.order[self.merge_id[k]] < limit)
            ok[at[bad]] = False
            oa, ob = self.order[a], self.order[b]
            undo_a = oa > ob
            limit = np.where(undo_a, oa, ob + 1)
            go = ~bad & ((oa >= 0) | (ob >= 0))
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go]
            at, limit = at[go], limit[go]
        return ok


class Encoder:
    """Encodes slices of texts; keeps the encodings of words it has met."""

    def __init__(self, vocab: Vocabulary, memory: int = 300_000) -> None:
        self.v, self.memory = vocab, memory
        self.known: dict[str, int] = {}
        self.pool, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair_key, self.pair_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As the vocabulary's, through a table of pairs decided before."""
        key = a * (self.v.n + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            distinct, back = np.unique(key[new], return_inverse=True)
            got = self.v.compatible(distinct // (self.v.n + 1), distinct % (self.v.n + 1))
            ok[new] = got[back]
            s = ((distinct.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            self.pair_key[s], self.pair_ok[s] = distinct, got
            # two pairs may share a slot: keep what the stored key says
            self.pair_ok[s] = got[np.searchsorted(distinct, self.pair_key[s])]
        return ok

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces occur in a coded text: start of each edge and its piece (index among the usable pieces)."""
        v, n = self.v, len(codes)
        padded = np.append(codes, np.zeros(v.parts * 4, np.uint64))
        four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        suffixes = np.argsort(four[:n])
        rank, width = dense(four[:n], suffixes), 4
        while width < v.longest:  # prefix doubling
            behind = np.append(rank[width:], np.zeros(min(width, n), np.int64))[:n]
            key = rank * (n + 1) + behind
            suffixes = np.argsort(key)
            rank, width = dense(key, suffixes), width * 2
        columns = [four[suffixes + 4 * k] for k in range(v.parts)]

        def bound(want: list[np.ndarray], after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), n)
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = np.minimum((lo + hi) // 2, n - 1)
                less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for c, w in zip(columns, want, strict=True):
                    x = c[mid]
                    less |= same & (x < w)
                    same &= x == w
                up = (less | same if after else less) & open_
                lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)

        lo, hi = bound(v.low, False), bound(v.high, True)
        many = hi - lo
        piece = np.repeat(np.arange(len(many)), many)
        at = suffixes[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[piece]]
        return at, piece

    def learn(self, words: list[str]) -> None:
        """Encode words not met before."""
        v = self.v
        plain = [w for w in words if MARK not in w[1:]]
        lens = np.array([len(w) for w in plain], np.int64)
        encoded: dict[str, list[int]] = {w: v.merged(w) for w in words if MARK in w[1:]}
        if plain:
            x = np.frombuffer("\0".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
            x = np.append(x, np.uint32(0))
            begin = np.cumsum(lens + 1) - (lens + 1)
            k = np.minimum(np.searchsorted(v.chars, x), len(v.chars) - 1)
            known = v.chars[k] == x
            codes = np.where(known, k + 1, 0).astype(np.uint64)
            border = np.zeros(len(x), bool)
            border[begin + lens] = True
            codes[border] = 0
            at, piece = self.occurrences(codes)
            token, end = v.piece_ids[piece], at + v.piece_len[piece]
            odd = np.flatnonzero((codes == 0) & ~border)  # characters without a piece: an edge of their own
            at, token, end = np.append(at, odd), np.append(token, np.full(len(odd), v.n)), np.append(end, odd + 1)
            word_of = np.repeat(np.arange(len(plain)), lens + 1)
            level = end - begin[word_of[at]]
            order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
            at, token, end, level = at[order], token[order], end[order], level[order]
            last, back = np.full(len(x) + 1, -1, np.int64), np.zeros(len(x) + 1, np.int64)
            hits = np.zeros(len(x) + 1, np.int8)
            cuts = np.flatnonzero(np.diff(level, prepend=-1, append=-1)) if len(level) else [0]
            first = np.zeros(len(x) + 1, bool)
            first[begin] = True
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # relax: all edges that end after so many characters
                s, t, e = at[a:b], token[a:b], end[a:b]
                before = last[s]
                ok = first[s]
                ask = np.flatnonzero(~ok & (before >= 0))
                if len(ask):
                    ok[ask] = self.compatible(before[ask], t[ask])
                s, t, e = s[ok], t[ok], e[ok]
                last[e], back[e] = t, s
                np.add.at(hits, e, 1)
            inner = ~border
            inner_end = np.flatnonzero(inner) + 1
            unsure = np.unique(word_of[inner_end[hits[inner_end] != 1] - 1])
            for w in unsure.tolist():
                encoded[plain[w]] = v.merged(plain[w])
            # walk back from the ends of all words at once
            sure = np.setdiff1d(np.arange(len(plain)), unsure, assume_unique=True)
            pos = (begin + lens)[sure]
            got_word, got_at, got_token = [], [], []
            while len(pos):
                got_word.append(sure), got_at.append(back[pos]), got_token.append(last[pos])
                pos = back[pos]
                on = pos > begin[sure]
                pos, sure = pos[on], sure[on]
            if got_word:
                p, t = np.concatenate(got_at), np.concatenate(got_token)
                o = np.argsort(p)
                p, t = p[o], t[o]
                w = word_of[p]
                plain_ids, plain_words = self.spell(t, x[p], w)
                bounds = np.searchsorted(plain_words, np.arange(len(plain) + 1))
                base = len(self.pool)
                self.pool = np.append(self.pool, plain_ids)
                is_sure = np.diff(bounds) > 0
                self.add([plain[i] for i in np.flatnonzero(is_sure)], base + bounds[:-1][is_sure], np.diff(bounds)[is_sure])
        for w, syms in encoded.items():
            ids = np.concatenate([self.v.bytes[np.frombuffer(chr(-1 - s).encode("utf-8", "surrogatepass"), np.uint8)] if s < 0 else np.array([s], np.int32) for s in syms])
            self.add([w], np.array([len(self.pool)]), np.array([len(ids)]))
            self.pool = np.append(self.pool, ids.astype(np.int32))

    def spell(self, tokens: np.ndarray, chars: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with characters without a piece replaced by byte tokens."""
        odd = np.flatnonzero(tokens == self.v.n)
        if not len(odd):
            return tokens.astype(np.int32), words
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in chars[odd].tolist()]
        many = np.ones(len(tokens), np.int64)
        many[odd] = [len(s) for s in spelled]
        out, words = np.repeat(tokens, many), np.repeat(words, many)
        out[out == self.v.n] = self.v.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return out.astype(np.int32), words

    def add(self, words: list[str], start: np.ndarray, count: np.ndarray) -> None:
        base = len(self.start)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.start, self.count = np.append(self.start, start), np.append(self.count, count)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > self.memory:
            self.__init__(self.v, self.memory)
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.known))
        if fresh:
            self.learn(fresh)
        get = self.known
        index = np.fromiter((get[w] for words in split for w in words), np.int64)
        per_word, first = self.count[index], self.start[index]
        ends = np.cumsum(per_word)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - per_word, per_word) + np.repeat(first, per_word)]
        words_upto = np.cumsum([len(w) for w in split]) if split else np.zeros(0, np.int64)
        upto = np.append(0, ends)[words_upto.astype(np.int64)]
        return ids, np.diff(np.append(0, upto))


def dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of keys given in sorted order."""
    s = key[order]
    r = np.empty(len(key), np.int64)
    r[order] = np.cumsum(np.append(True, s[1:] != s[:-1]))
    return r


def decode_bytes(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and where each token ends."""
    many = v.out_len[ids]
    ends = np.cumsum(many)
    data = v.out[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(v.out_at[ids], many)]
    return data, ends


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids, and round_trip: whether decoding gives the text again."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    held: list[Encoder] = []

    def f(part: pa.RecordBatch) -> dict:
        if not held:
            held.append(Encoder(shared.value))
        texts = part.column("text").to_pylist()
        ids, many = held[0].encode(texts)
        data, ends = decode_bytes(shared.value, ids)
        upto = np.append(0, ends)[np.append(0, np.cumsum(many))]
        raw = data.tobytes()
        same = [raw[a + (b > a) : b] == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass") for a, b, t in zip(upto[:-1].tolist(), upto[1:].tolist(), texts, strict=True)]
        return {"n_tokens": many, "ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(ids.astype(np.int32))), "round_trip": same}

    return map_texts(docs, f, "n_tokens long, ids array<int>, round_trip boolean", list(keep), limit=2 << 20)


def decode(tokens: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text, from a column of ids. Null ids read as empty; bytes that are no UTF-8 are replaced."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        for b in batches:
            texts = []
            for ids in b.column("ids").to_pylist():
                data, _ = decode_bytes(shared.value, np.array(ids or [], np.int64))
                texts.append(data[1:].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    return tokens.select(*keep, "ids").mapInArrow(run, StructType([*(tokens.schema[k] for k in keep), StructField("text", StringType())]))
