import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm.concat_cut import Encoder, concatenate_and_cut, sequences, token_ids, windows

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  two", "two ", "one", "a b", "a  b", " a b ", "line\nline", "line \n line", "tab\t x", "é été ü", "漢字 かな", "\x00 \x1c x", "x　 y", "it's 12ab, ok.", "\n", "a" * 3000, "b c " * 2000, "x <|endoftext|> y", "<|endoftext|>", "a <|endoftext|>b"]
TOKENIZER = Tokenizer.from_file(FILE)


def expected_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab é\n\t .,'漢 1", k=rng.randint(0, 40))) for _ in range(300)]
    ids, begin = token_ids(pa.array(texts, pa.large_string()), Encoder(FILE), 0)
    assert len(begin) == len(texts) + 1
    for text, a, b in zip(texts, begin[:-1], begin[1:], strict=True):
        assert ids[a:b].tolist() == expected_ids(text), repr(text)
    nothing, begin = token_ids(pa.array([], pa.large_string()), Encoder(FILE), 0)
    assert len(nothing) == 0 and begin.tolist() == [0]


@pytest.mark.parametrize(("total", "window"), [(0, 8), (7, 8), (8, 8), (29, 8), (1000, 1024), (123457, 1024), (50, 12)])
def test_windows_need_no_padding(total, window):
    edges = windows(total, window)
    assert edges[0] == total - total % window and edges[-1] == total
    tail = np.diff(edges)
    assert all(n & (n - 1) == 0 and n < window for n in tail.tolist()) and len(set(tail.tolist())) == len(tail)


@pytest.mark.parametrize("window", [1, 7, 64, 1024])
def test_every_id_lies_in_one_window(spark, window):
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 3), (None, "no id", 1), (None, "no id", 1), (500, None, 1)]
    if window < 64:
        rows = [r for r in rows if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3)
    out = concatenate_and_cut(docs, FILE, window=window, ids=True)
    held = out.collect()
    by_window, pieces = defaultdict(list), defaultdict(list)
    for r in held:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.crc and len(r.ids) == r.length > 0
        by_window[r.sequence_id].append((r.offset, r.ids))
        pieces[r.id].append((r.start, r.ids, r.doc_tokens))
    total = sum(len(expected_ids(t)) for _, t, _ in rows)
    sizes = []
    for n in range(len(by_window)):
        at = 0
        for offset, ids in sorted(by_window[n]):
            assert offset == at
            at += len(ids)
        sizes.append(at)
    assert sum(sizes) == total and sizes[: total // window] == [window] * (total // window)
    assert all(n & (n - 1) == 0 for n in sizes[total // window :])
    for i, text, _ in {r for r in rows if r[0] not in (None, 0)}:
        whole = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
        assert whole == expected_ids(text) and {n for _, _, n in pieces[i]} == {len(whole)}
        assert [s for s, _, _ in sorted(pieces[i])] == np.cumsum([0] + [len(p) for _, p, _ in sorted(pieces[i])])[:-1].tolist()
    assert sum(len(p) for _, p, _ in pieces[None]) == 2 * len(expected_ids("no id")) and len(pieces[500]) == 1
    joined = {r.sequence_id: r.ids for r in sequences(out).collect()}
    assert [len(joined[n]) for n in range(len(sizes))] == sizes
    assert joined == {n: [x for _, ids in sorted(parts) for x in ids] for n, parts in by_window.items()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert concatenate_and_cut(docs, FILE).count() == 0
    with pytest.raises(ValueError):
        concatenate_and_cut(docs, FILE, window=0)
