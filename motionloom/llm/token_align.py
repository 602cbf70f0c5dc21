"""Cross-tokenizer alignment: which runs of tokens of one tokenizer cover the same bytes as runs of another.

Method: a dangling-suffix transducer. It reads the tokens of A and B of one text and keeps which side leads and the
bytes by which it leads (the residual). The side behind gives the next token; the residual and that token decide the
next residual, a transition that is computed once and kept. Where the residual becomes empty, both sides end at one
byte and a group is closed; the last tokens of the group are linked.

On Spark: a text falls into segments at single blanks over which neither tokenizer merges, so the residual is empty
between them; a worker keeps the finished groups of the segments it has met. `alignments` makes one row a document
with its links as numbers of a dictionary of pairs. Two linked tokens end at one byte, so the bytes of one are a suffix
of the bytes of the other: the dictionary of all such pairs follows from the vocabularies alone, and its size (some
hundred thousand rows, whatever the corpus) bounds the counts that tasks add up and that are broadcast to score links.

Edge cases: a null or empty text, and one whose tokens of A or B do not spell space + text (U+2581 in a text, for one),
has no tokens: zeros and the empty string. Strings of special tokens are plain text. Repeated rows are counted as
often as they occur; a null id is kept; ties for the highest count are all best. A very long text is read whole; a
text without blanks is one segment, aligned by itself and not kept. An empty table gives an empty result; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready, release, texts_of
from .packing import BYTE_CHARS

#: Segments a worker keeps with their groups, states of its transducer, and the longest segment that is kept.
CACHED_SEGMENTS = 500_000
STATES = 1 << 17
LONGEST_KEPT = 48
#: Fixed value: how byte-level tokenizers cut a text before they merge.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character all libraries agree on what a letter or a number is.
KNOWN_LETTERS = "\u0250"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def token_bytes(a_path: str, b_path: str) -> tuple[list[bytes], list[bytes]]:
    """Bytes of each id of A and B; control and unknown tokens, which no text has, have none."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as file:
        told = json.load(file)
    vocabulary, special = told["model"]["vocab"], {t["content"] for t in told["added_tokens"] if t["special"]}
    of_char = {c: b for b, c in BYTE_CHARS.items()}
    a = [b""] * (max([*vocabulary.values(), *(t["id"] for t in told["added_tokens"])]) + 1)
    for piece, n in vocabulary.items():
        a[n] = b"" if piece in special else bytes(map(of_char.__getitem__, piece))
    model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b = [b""] * model.vocab_size()
    for n in range(len(b)):
        if model.is_byte(n):
            b[n] = bytes([int(model.id_to_piece(n)[3:-1], 16)])
        elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
            b[n] = model.id_to_piece(n).replace("▁", " ").encode()
    return a, b


@lru_cache(maxsize=2)
def pair_dictionary(a_path: str, b_path: str) -> np.ndarray:
    """All pairs that can be linked, as a << 32 | b, sorted: those where the bytes of one token end the bytes of the other."""
    a, b = token_bytes(a_path, b_path)
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for side, tokens in enumerate((a, b)):
        for n, spelt in enumerate(tokens):
            if spelt:
                by_bytes[side].setdefault(spelt, []).append(n)
    found = set()
    for n, spelt in enumerate(a):
        for at in range(len(spelt)):
            found.update(n << 32 | m for m in by_bytes[1].get(spelt[at:], ()))
    for m, spelt in enumerate(b):
        for at in range(1, len(spelt)):
            found.update(n << 32 | m for n in by_bytes[0].get(spelt[at:], ()))
    return np.array(sorted(found), dtype=np.int64)


class Transducer:
    """Closes groups of A and B tokens. A state is a residual and the side it belongs to; odd ones are led by A."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], most: int = STATES):
        self.bytes, self.most = (a_bytes, b_bytes), most
        self.clear()

    def clear(self) -> None:
        self.residuals, self.numbers, self.moves = {0: b""}, {(0, b""): 0}, {}

    def _move(self, state: int, token: int) -> int:
        """The state after the side behind has given `token`: B where A leads, else A."""
        behind = state & 1
        leads, given = self.residuals[state], self.bytes[behind][token]
        if leads.startswith(given):
            side, rest = behind, leads[len(given) :]
        elif given.startswith(leads):
            side, rest = 1 - behind, given[len(leads) :]
        else:
            raise ValueError("the tokens spell different bytes")
        key = (side, rest) if rest else (0, b"")
        if key not in self.numbers:
            self.numbers[key] = number = 2 * len(self.numbers) + side
            self.residuals[number] = rest
        self.moves[state << 20 | token] = self.numbers[key]
        return self.numbers[key]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """How many tokens of a and b lie before the end of each group. Both lists spell the same bytes."""
        if len(self.moves) > self.most:
            self.clear()
        moves, state, i, j, ends = self.moves, 0, 0, 0, []
        try:
            while True:
                if state & 1:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                try:
                    state = moves[state << 20 | token]
                except KeyError:
                    state = self._move(state, token)
                if not state:
                    ends.append((i, j))
        except IndexError:
            return ends


class Aligner:
    """Groups of whole texts, from segments that are aligned once and kept: text -> (groups, links, n_a) or None."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = token_bytes(a_path, b_path)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        ranks = {spelt: n for n, spelt in enumerate(self.a_bytes) if spelt}
        self.quick = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.a_lengths = np.array([len(spelt) for spelt in self.a_bytes], np.int64)
        self.a_told, self.b_told = [str(n) for n in range(len(self.a_bytes))], [str(n) for n in range(len(self.b_bytes))]
        self.pairs = {int(p): n for n, p in enumerate(pair_dictionary(a_path, b_path))}
        self.known: dict[str, tuple | None] = {}

    def _align(self, segments: list[str]) -> dict[str, tuple]:
        """Each segment, without the blank before it: its groups as text, links (uint32) and number of A tokens; groups
        are None where the tokens do not spell it."""
        found, plain, other = {}, [], []
        for s in segments:
            (plain if s.isprintable() and " " not in s and max(s, default=KNOWN_LETTERS) < KNOWN_LETTERS else other).append(s)
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            found.update(zip(part, map(self._told, part, self._quick(part), self.b.encode(part, num_threads=1)), strict=True))
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            coded = self.a.encode_batch([" " + s for s in part], add_special_tokens=False)
            found.update(zip(part, map(self._told, part, [c.ids for c in coded], self.b.encode(part, num_threads=1)), strict=True))
        return found

    def _quick(self, words: list[str]) -> list[list[int]]:
        """A's tokens of words without white space, all merged in one go: none reaches over the blank before a word."""
        ids = self.quick.encode_ordinary(" " + " ".join(words))
        ends = np.cumsum(self.a_lengths[ids])
        last = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = (np.searchsorted(ends, last) + 1).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]

    def _told(self, segment: str, a: list[int], b: list[int]) -> tuple:
        spelt = (" " + segment).encode()
        if b"".join([self.a_bytes[n] for n in a]) != spelt or b"".join([self.b_bytes[n] for n in b]) != spelt:
            return None, b"", 0
        told, links, i, j, a_told, b_told = [], array("I"), 0, 0, self.a_told, self.b_told
        for i_end, j_end in self.transducer.groups(a, b):
            left = a_told[a[i]] if i_end == i + 1 else ",".join([a_told[n] for n in a[i:i_end]])
            right = b_told[b[j]] if j_end == j + 1 else ",".join([b_told[n] for n in b[j:j_end]])
            told.append(f"{left}|{right}")
            links.append(self.pairs[a[i_end - 1] << 32 | b[j_end - 1]])
            i, j = i_end, j_end
        return ";".join(told), links.tobytes(), len(a)

    def texts(self, texts: list[str]) -> list[tuple | None]:
        split = [text.split(" ") for text in texts]
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHED_SEGMENTS:  # what this batch has goes on
            self.known = {w: self.known[w] for w in words.difference(new)}
        known = self.known
        known.update({w: None for w in new if not w or w[0].isspace() or w[-1].isspace()})
        known.update(self._align([w for w in new if w not in known]))
        glued = {n: _glued(words) for n, words in enumerate(split) if None in map(known.__getitem__, words)}
        more = self._align(list(set().union(*glued.values())))
        out = []
        for n, (text, words) in enumerate(zip(texts, split, strict=True)):
            entries = [more[s] for s in glued[n]] if n in glued else [known[w] for w in words]
            told = [e[0] for e in entries]
            out.append((";".join(told), b"".join([e[1] for e in entries]), sum([e[2] for e in entries])) if text and None not in told else None)
        for word in [w for w in new if len(w) > LONGEST_KEPT]:
            del known[word]
        return out


def _glued(words: list[str]) -> list[str]:
    """Segments of a text that was split at blanks: a blank stays inside a segment where white space stands on both of
    its sides or at the text's ends, as tokens may reach over it."""
    segments, open_ = [], words[:1]
    for before, word in zip(words, words[1:], strict=False):
        if not before or not word or before[-1].isspace() and word[0].isspace():
            open_.append(word)
        else:
            segments.append(" ".join(open_))
            open_ = [word]
    return [*segments, " ".join(open_)]


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (as `a1,a2|b1;a3|b2,b3`), groups_sha256, links (zstd of uint32 numbers of
    `pair_dictionary`, in order), n_links for every row of docs."""
    ready(docs.sparkSession)
    paths = tuple(p or d for p, d in zip((a_path, b_path), default_tokenizers(), strict=True))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, {'groups string, ' if with_groups else ''}groups_sha256 string, links binary"

    def each(batches):
        aligner, codec = Aligner(*paths), pa.Codec("zstd", 1)
        for batch in batches:
            rows = []
            for found in aligner.texts(list(texts_of(batch.column(1)))):
                told, links, n_a = found or ("", b"", 0)
                count = len(links) // 4
                n_b = told.count(",") + told.count("|") + told.count(";") + (count > 0) - n_a
                digest = sha256(told.encode()).hexdigest() if found else ""
                rows.append((n_a, n_b, count, count, *((told,) if with_groups else ()), digest, codec.compress(links, asbytes=True) if links else b""))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (7 if with_groups else 6)
            kinds = [*[pa.int64()] * 4, *[pa.string()] * (2 if with_groups else 1), pa.binary()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*"doc_id n_a n_b n_groups n_links".split(), *(["groups"] if with_groups else []), "groups_sha256", "links"])
        aligner = None
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def _links_of(batch: pa.RecordBatch, column: int, sizes: list[int]) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    return [
        np.frombuffer(codec.decompress(v.as_py(), 4 * n, asbytes=True), dtype="<u4") if n else np.empty(0, np.uint32)
        for v, n in zip(batch.column(column), sizes, strict=True)
    ]


def pair_counts(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """pair (number in the dictionary), a, b, n, is_best (no pair with this b has more) of all links of `aligned`."""
    paths = tuple(p or d for p, d in zip((a_path, b_path), default_tokenizers(), strict=True))

    def count(batches):
        pairs = pair_dictionary(*paths)
        total = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for links in _links_of(batch, 1, batch.column(0).to_pylist()):
                if len(links) > len(pairs):
                    total += np.bincount(links, minlength=len(pairs))
                else:
                    np.add.at(total, links, 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            arrays = [k.astype(np.int32), (pairs[k] >> 32).astype(np.int32), (pairs[k] & 0xFFFFFFFF).astype(np.int32), total[k]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["pair", "a", "b", "n"])

    parts = aligned.select("n_links", "links").mapInArrow(count, "pair int, a int, b int, n long")
    summed = parts.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
    return summed.withColumn("is_best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def scored(aligned: DataFrame, counts: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """`aligned` (a checkpointed table) with n_best and count_sum in place of links. counts: of `pair_counts`."""
    spark = aligned.sparkSession
    paths = tuple(p or d for p, d in zip((a_path, b_path), default_tokenizers(), strict=True))
    table = counts.select("pair", "n", "is_best").toPandas()  # at most one row for each pair of the dictionary
    dense, best = np.zeros(len(pair_dictionary(*paths)), np.int64), np.zeros(len(pair_dictionary(*paths)), bool)
    dense[table["pair"]], best[table["pair"]] = table["n"], table["is_best"]
    shared = spark.sparkContext.broadcast((dense, best))
    keep = [c for c in aligned.columns if c != "links"]
    at = len(keep)

    def score(batches):
        dense, best = shared.value
        for batch in batches:
            links = _links_of(batch, at, batch.column(keep.index("n_links")).to_pylist())
            more = [pa.array([int(best[x].sum()) for x in links], pa.int64()), pa.array([int(dense[x].sum()) for x in links], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *more], [*keep, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in keep)
    return aligned.select(*keep, "links").mapInArrow(score, f"{schema}, n_best long, count_sum long")


def op13_alignments(docs: DataFrame) -> DataFrame:
    aligned = cut(alignments(docs, with_groups=False))
    told = scored(aligned, pair_counts(aligned))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
