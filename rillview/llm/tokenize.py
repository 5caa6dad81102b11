"""Byte-level BPE encoding and decoding by tree concatenation.

Every text longer than `leaf` characters is halved, at whatever character its middle is, until all parts fit. The leaves are encoded
each by itself (those of long texts by several threads, as the encoder runs outside Python's lock); then neighbours are joined
upwards as a tree. At a join the tokens around it are encoded again as one window, from a place in the left part to one in the right
part where the pre-tokeniser surely cuts (before a space or line feed that follows no white space). The window grows until
its first and its last piece have exactly the tokens that both sides gave them; as such pieces are encoded alike in
any surroundings, all before and behind is then right as well.

If no such place is near (long unsplit text), the pre-tokens around the join are found, and a pre-token that spans it is joined from
its parts' tokens: a window of tokens grows until its first and its last token are those of the two sides. Every adjacent
pair of tokens then occurs in some correct encoding, which makes the whole one correct (byte-pair encodings are those sequences
whose adjacent pairs are).

Defined cases: null and empty texts give no ids and the empty text; special tokens written in a text become their ids, as
with the library; texts of any length are encoded whole; repeated rows, null ids and extra columns of any name do no harm (one row
for each row); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillview.llm.common import chunks

#: Characters of a leaf; leaves of a text of which a thread starts to help; threads.
LEAF, MANY, THREADS = 1024, 64, 2
#: Tokens on each side of a join within a pre-token, at first.
WINDOW = 4
#: Fixed value: the pre-tokeniser's pattern ("ByteLevel" in the vocabulary file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf = leaf
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        back = byte_alphabet()
        self.as_text = str.maketrans({chr(b): c for c, b in back.items()})  # of a text decoded as Latin-1
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        self.name_of = [str(i) for i in range(len(self.bytes_of))]
        self.size_of = [len(b) for b in self.bytes_of]
        self.ranked = self._ranked(spec)
        #: how often two parts were joined; of these, how often the window grew, and how often no sure place was near
        self.joined = self.grown = self.unsplit = 0

    @staticmethod
    def _check(spec: dict) -> None:
        """What the joins rely on."""
        cutter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        for x in spec["added_tokens"]:
            if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"]):
                raise ValueError(f"special token {x['content']!r} is matched in a way that is not supported")

    def _ranked(self, spec: dict):
        """A faster encoder of leaves with the same results, if the ids of merged tokens follow the order of the merges; else None."""
        import tiktoken

        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)) or any(len(self.bytes_of[i]) > 1 for i in set(vocab.values()) - set(made)) or spec["model"].get("ignore_merges"):
            return None
        lowest = made[0] if made else 0
        if any(i > lowest for i in vocab.values() if len(self.bytes_of[i]) == 1) or len({i for i in vocab.values() if len(self.bytes_of[i]) == 1}) != 256:
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes_of[i]: i for i in vocab.values()}, special_tokens=self.special)

    # -- leaves --------------------------------------------------------------------------------------------------
    def whole(self, text: str) -> list[int]:
        """The encoding of a short text by the library."""
        if self.ranked is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.special_re and self.special_re.search(text):
            return self.ranked.encode(text, allowed_special="all")
        return self.ranked.encode_ordinary(text)

    def leaves(self, parts: list[str]) -> list[list[int]]:
        if len(parts) < MANY or self.ranked is None:
            return [self.whole(p) for p in parts]
        return self.ranked.encode_batch(parts, num_threads=THREADS, allowed_special="all")

    # -- joins ---------------------------------------------------------------------------------------------------
    def tree(self, text: str) -> list[int]:
        """Halves down to leaves, joins upwards."""
        n, depth = len(text), 0
        while n > self.leaf << depth:
            depth += 1
        cuts = [n * i >> depth for i in range((1 << depth) + 1)]
        level = self.leaves([text[a:z] for a, z in zip(cuts, cuts[1:], strict=False)])
        while len(level) > 1:
            level = [self.join(text, cuts[i], cuts[i + 1], cuts[i + 2], level[i], level[i + 1]) for i in range(0, len(level), 2)]
            cuts = cuts[::2]
        return level[0]

    def _sure_before(self, text: str, lo: int, at: int) -> int:
        """The last place between lo and `at` where the pre-tokeniser surely cuts, or lo."""
        while at > lo:
            at = max(text.rfind(" ", lo, at), text.rfind("\n", lo, at))
            if at <= lo:
                break
            if not text[at - 1].isspace():
                return at
        return lo

    def _sure_behind(self, text: str, at: int, hi: int) -> int:
        """The first such place from `at` on, or hi."""
        while at < hi:
            found = [x for x in (text.find(" ", at, hi), text.find("\n", at, hi)) if x >= 0]
            if not found:
                break
            at = min(found)
            if at and not text[at - 1].isspace():
                return at
            at += 1
        return hi

    def _last(self, ids: list[int], n: int) -> int:
        """Where the tokens of the last n bytes begin; -1 if no token does."""
        k = len(ids)
        while n > 0:
            k -= 1
            n -= self.size_of[ids[k]]
        return k if n == 0 else -1

    def _first(self, ids: list[int], n: int) -> int:
        """Where the tokens of the first n bytes end; -1 if no token does."""
        k = 0
        while n > 0:
            n -= self.size_of[ids[k]]
            k += 1
        return k if n == 0 else -1

    def join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        self.joined += 1
        most, size = 2 * self.leaf, lambda i, j: len(text[i:j].encode("utf-8"))
        sure = lambda at: at in (lo, hi) or self._is_sure(text, at)
        near_a, near_b = self._sure_before(text, max(lo, mid - most), mid), self._sure_behind(text, mid, min(hi, mid + most))
        far_a, far_b = near_a, near_b
        while sure(far_a) and sure(far_b) and far_b - far_a <= 2 * most:
            far_a, far_b = self._sure_before(text, max(lo, far_a - most), far_a), self._sure_behind(text, min(hi, far_b + 1), min(hi, far_b + most))
            if not sure(far_a) or not sure(far_b):
                break
            window = self.whole(text[far_a:far_b])
            if (far_a, far_b) == (lo, hi):
                return window
            i, j = self._last(a, size(far_a, mid)), self._first(b, size(mid, far_b))
            # the outer pieces, as both sides have them and as the window has them
            left, right = a[i : self._last(a, size(near_a, mid))], b[self._first(b, size(mid, near_b)) : j]
            if i >= 0 and j >= 0 and window[: len(left)] == left and window[len(window) - len(right) :] == right:
                return a[:i] + window + b[j:]
            self.grown += 1
        return self._unsplit_join(text, lo, mid, hi, a, b)

    def _is_sure(self, text: str, at: int) -> bool:
        return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()

    # -- long unsplit text ---------------------------------------------------------------------------------------
    def _plain(self, data: bytes) -> list[int]:
        """The merges alone, without pre-tokeniser."""
        return [t.id for t in self.tokenizer.model.tokenize(data.decode("latin-1").translate(self.as_text))]

    def _meet(self, a: list[int], b: list[int]) -> list[int]:
        """The merges over two neighbouring strings, from theirs."""
        if not a or not b:
            return a + b
        k = WINDOW
        while True:
            left, right = a[-k:], b[:k]
            mid = self._plain(b"".join(self.bytes_of[i] for i in left + right))
            if (k >= len(a) or mid[0] == left[0]) and (k >= len(b) or mid[-1] == right[-1]):
                return a[: max(0, len(a) - k)] + mid + b[k:]
            k *= 2

    def _pre_tokens(self, text: str, shift: int) -> list[tuple[int, int, bool]]:
        """Start, end (in bytes, from `shift` on) and whether it is a special token."""
        out = []
        for part in self.special_re.split(text) if self.special_re else [text]:
            if part in self.special:
                out.append((shift, shift := shift + len(part.encode("utf-8")), True))
            elif part:
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):  # a character for each byte
                    out.append((shift, shift := shift + len(piece), False))
        return out

    def _unsplit_join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        self.unsplit += 1
        p, r = self._sure_before(text, lo, mid), self._sure_behind(text, mid, hi)
        data = text[p:r].encode("utf-8")
        cut = len(text[p:mid].encode("utf-8"))
        i, j = self._last(a, cut), self._first(b, len(data) - cut)
        ends = [0]
        for x in a[i:] + b[:j]:
            ends.append(ends[-1] + self.size_of[x])
        own, place = a[i:] + b[:j], {e: k for k, e in enumerate(ends)}
        left, right, now = self._pre_tokens(text[p:mid], 0), self._pre_tokens(text[mid:r], cut), self._pre_tokens(text[p:r], 0)
        same = 0
        while same < min(len(left), len(now)) and left[same] == now[same]:
            same += 1
        kept = 0
        while kept < min(len(right), len(now) - same) and right[-1 - kept] == now[-1 - kept]:
            kept += 1
        known = {(s, e) for s, e, _ in left + right}
        bounds = sorted({s for s, _, _ in left + right} | {cut})
        middle: list[int] = []
        at = 0
        for s, e, special in now[same : len(now) - kept]:
            if special:
                middle.append(self.special[data[s:e].decode("utf-8")])
                continue
            while at < len(bounds) and bounds[at] <= s:
                at += 1
            inner = at
            while inner < len(bounds) and bounds[inner] < e:
                inner += 1
            edges, ids = [s, *bounds[at:inner], e], []
            for f, g in zip(edges, edges[1:], strict=False):
                ids = self._meet(ids, own[place[f] : place[g]] if (f, g) in known else self._plain(data[f:g]))
            middle += ids
        first = place[now[same - 1][1]] if same else 0
        last = place[now[len(now) - kept][0]] if kept else len(own)
        return a[:i] + own[:first] + middle + own[last:] + b[j:]

    # -- whole texts ---------------------------------------------------------------------------------------------
    def encode(self, text: str | None) -> list[int]:
        return self.tree(text) if text else []

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_OWN: dict[tuple[str, int], Bpe] = {}


def bpe(path: str, leaf: int = LEAF) -> Bpe:
    """One for each Python worker."""
    if (path, leaf) not in _OWN:
        _OWN[path, leaf] = Bpe(path, leaf)
    return _OWN[path, leaf]


def default_vocabulary() -> str:
    """Found on each executor: the file belongs to an installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, full: bool = False, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with `full` also ids (array<int>) and decoded."""
    frame = docs.select(F.col("doc_id"), F.col("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(vocabulary or default_vocabulary(), leaf)
        sha = lambda t: hashlib.sha256(t.encode("utf-8")).hexdigest()
        for batch in chunks(batches, 1):
            n, ids_sha, text_sha, every, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                back = own.decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(",".join([own.name_of[i] for i in ids])))
                text_sha.append(sha(back))
                if full:
                    every.append(pa.array(ids, pa.int32()))
                    decoded.append(back)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                offsets = pa.array(_offsets(n), pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, pa.concat_arrays(every)), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)


def _offsets(sizes: list[int]) -> list[int]:
    out = [0]
    for n in sizes:
        out.append(out[-1] + n)
    return out
