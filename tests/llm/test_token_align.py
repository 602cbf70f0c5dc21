"""Token alignment against a plain reading of its definition, over the whole table and odd texts."""

import hashlib
from collections import Counter

import pytest
from corpus import odd_rows

from motionloom.llm import token_align

ODD = [
    "a", "  a  b ", "x \t\n y", "▁x", "a▁b", "a\x00b", "foo\t \nbar  baz \n", "<|endoftext|> <s> x</s><unk>", "\xa0 　 z", " \n a",
    "a \x1c b", "a\x85 \x85b", "é😀中文 字", " ", "   ", "a" * 20000, "it's 'tis  ' s", "\n \n", "x\n \ny \n", "don't WE'LL I'm", "²½ª ǅ ȷ ɐ",
    "​ ​́ é", "naïve café x", "tab\tend\t", "12 345٠१ 6", "\U0010ffff ￾",
]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = token_align.default_tokenizers()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    return a, b


def spelt_a(a, ids):
    """Entry by entry: the printable characters of byte-level vocabularies back to bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(n): n for n in printable}
    for k, n in enumerate(n for n in range(256) if n not in printable):
        chars[chr(256 + k)] = n
    return [bytes(chars[c] for c in a.id_to_token(n)) for n in ids]


def spelt_b(b, ids):
    pieces = [b.id_to_piece(n) for n in ids]
    return [bytes([int(p[3:5], 16)]) if b.is_byte(n) else p.replace("▁", " ").encode() for n, p in zip(ids, pieces, strict=True)]


def plain(tools, text):
    """Groups (lists of A and of B ids) by offsets."""
    a, b = tools
    ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    parts_a, parts_b, want = spelt_a(a, ids_a), spelt_b(b, ids_b), (" " + (text or "")).encode()
    if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
        return []
    ends_a = {sum(map(len, parts_a[: i + 1])): i + 1 for i in range(len(ids_a))} if len(ids_a) < 500 else ends_of(parts_a)
    ends_b = ends_of(parts_b)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append((ids_a[i : ends_a[end]], ids_b[j : ends_b[end]]))
        i, j = ends_a[end], ends_b[end]
    return groups


def ends_of(parts):
    found, at = {}, 0
    for n, part in enumerate(parts):
        at += len(part)
        found[at] = n + 1
    return found


def brute(tools, rows):
    aligned = [(i, plain(tools, text)) for i, text in rows]
    counts = Counter((a[-1], b[-1]) for _, groups in aligned for a, b in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, groups in aligned:
        links = [(a[-1], b[-1]) for a, b in groups]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            str(i), sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def check(spark, tools, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in token_align.op13_alignments(docs).collect())
    assert got == brute(tools, rows)


def test_whole_table(spark, sf_dir, tools):
    check(spark, tools, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_texts(spark, tools):
    rows = [(n, t) for n, t in enumerate(ODD)] + [(r[0], r[1]) for r in odd_rows()]
    check(spark, tools, spark.createDataFrame(rows, "doc_id long, text string"))
    assert any(not plain(tools, t) for t in ODD) and sum(bool(plain(tools, t)) for t in ODD) > 15


def test_full_store_and_full_table_of_states(spark, tools, monkeypatch):
    """The same groups where segments are dropped from the store and states from the table after every batch."""
    monkeypatch.setattr(token_align, "CACHED_SEGMENTS", 3)
    aligner = token_align.Aligner(*token_align.default_tokenizers())
    aligner.transducer.most = 2
    for text in ODD + [r[1] or "" for r in odd_rows()]:
        want = plain(tools, text)
        got = aligner.texts([text])[0]
        assert (got or ("",))[0] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)


def test_groups_and_counts_are_real_outputs(spark, tools):
    docs = spark.createDataFrame([(1, "The cat's hat"), (2, "The cat")], "doc_id long, text string")
    aligned = token_align.alignments(docs)
    assert aligned.where("doc_id = 2").first().groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(tools, "The cat"))
    counts = {(r.a, r.b): r.n for r in token_align.pair_counts(aligned).collect()}
    assert counts == Counter((a[-1], b[-1]) for t in ("The cat's hat", "The cat") for a, b in plain(tools, t))


def test_every_pair_of_the_dictionary_shares_an_end():
    pairs = token_align.pair_dictionary(*token_align.default_tokenizers())
    a, b = token_align.token_bytes(*token_align.default_tokenizers())
    assert 200_000 < len(pairs) < 500_000
    for p in pairs[::997].tolist():
        x, y = a[p >> 32], b[p & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)
