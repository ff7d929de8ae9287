import hashlib
import random
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tessera.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(spark):
    return P.load_model(spark, PATH)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def texts(n=600):
    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "    ", "\n", "\t", "\r", "▁", "▁▁", "é", "é", "日本", "123", "😀", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "ing", "ﬁ", "​", "-"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return out + ["x" * 5000, " " * 999, "▁" * 50, "ab" * 3000 + "日" * 100, "", " ", "▁", "hello world " * 3000]


def literal(run: str, vocab: P.Pieces) -> list[str]:
    """Symbols of a run: again and again, the best pair of neighbours, the leftmost of equal ones, is put together."""
    symbols = list(run)
    while pairs := [(vocab.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in vocab.rank]:
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def test_agenda_against_the_rule(model):
    vocab = P.Pieces.of(model)
    rng = random.Random(3)
    for _ in range(400):
        run = "".join(rng.choice("▁▁▁aeinrst") for _ in range(rng.randint(1, 24)))
        want = [i for s in literal(run, vocab) for i in ([vocab.ids[s]] if s in vocab.ids else [vocab.bytes_[b] for b in s.encode()])]
        assert P.merge(run, vocab) == want, run


def test_short_and_long_runs_alike(model, monkeypatch):
    """The agenda as a list and as a heap, on runs with equal pairs and characters outside the vocabulary; short runs need no heap."""
    vocab, rng = P.Pieces.of(model), random.Random(8)
    runs = ["".join(rng.choice("▁▁aaeinrst😀é\ue000") for _ in range(rng.randint(1, P.SHORT))) for _ in range(2000)]
    monkeypatch.setattr(P, "SHORT", 0)
    want = [P.merge(run, vocab) for run in runs]
    monkeypatch.undo()
    monkeypatch.setattr(P.heapq, "heappop", None)
    assert [P.merge(run, vocab) for run in runs] == want


def test_words_side_by_side(model):
    """As one by one: of all short lengths, with spaces, equal pairs and characters outside the vocabulary."""
    vocab, rng = P.Pieces.of(model), random.Random(4)
    words = ["".join(rng.choice("▁▁aaeinrst1😀é\ue000\x00日") for _ in range(rng.randint(1, P.SHORT))) for _ in range(3000)]
    for bytes_ in (vocab.bytes_, []):
        vocab.bytes_ = bytes_
        got = P.Merger(vocab).ids(words)
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [P.merge(w, vocab) for w in words]


def test_side_by_side_with_equal_ranks():
    """The leftmost of equal pairs is first, whichever piece it makes; a character may be part of pieces and be none itself."""
    ids = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aa", "xa", "xab", "abab"], 1)}
    vocab = P.Pieces(ids, dict.fromkeys(ids, 1.0) | {"abab": 2.0, "xab": 0.5}, [], 0, 9, [""] * 10)
    words = ["".join(w) for n in range(1, 7) for w in product("abx", repeat=n)]
    got = [np.frombuffer(g, np.int32).tolist() for g in P.Merger(vocab).ids(words)]
    assert got == [P.merge(w, vocab) for w in words] == [[ids.get(s, 0) for s in literal(w, vocab)] for w in words]


def test_no_step_for_each_short_word(model, library, monkeypatch):
    """New short words are merged without a call for each."""
    rng = random.Random(6)
    some = [" ".join("".join(rng.choice("aeinrstéß") for _ in range(rng.randint(1, 20))) for _ in range(50)) for _ in range(40)]
    monkeypatch.setattr(P, "merge", None)
    assert P.Encoder(model).encode(some) == library.encode(some, add_eos=True)


def test_texts_of_ids_at_once(model):
    encoder = P.Encoder(model)
    for some in (texts(300), ["", ""], [" "], ["", "  a", "▁", "日\ue000", ""]):
        ids, ends = encoder.encode_all(some)
        assert encoder.decode_all(ids, ends).to_pylist() == [P.decode_ids(x, encoder.pieces.surface) for x in encoder.encode(some)]
    assert encoder.encode([]) == []


def test_pieces_of_letters_and_digits(model):
    """A piece with a letter beside a digit: words are cut before spaces only."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    assert len(set(P.Pieces.of(model).kinds().tolist())) == 3
    spec.pieces[20000].piece = "a1"
    changed = spec.SerializeToString()
    assert set(P.Pieces.of(changed).kinds().tolist()) == {0, 1}
    some = ["a1 ba1b 1a a1a1", "x.a11 a", *texts(200)]
    assert P.Encoder(changed).encode(some) == sentencepiece.SentencePieceProcessor(model_proto=changed).encode(some, add_eos=True)


def test_model_without_byte_pieces(model):
    """A strange character at a word's end meets the one that divides words in the check, which is no difference."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    spec.trainer_spec.byte_fallback = False
    for p in spec.pieces:
        if p.type == 6:
            p.type = 1
    changed = spec.SerializeToString()
    some = ["a word\ue000 and another\ue000", "日 a", "plain words"]
    assert P.Encoder(changed).encode(some) == sentencepiece.SentencePieceProcessor(model_proto=changed).encode(some, add_eos=True)


def test_texts_as_the_library(model, library):
    encoder, rng = P.Encoder(model), random.Random(5)
    want = library.encode(texts(4000), add_eos=True)
    assert encoder.encode(texts(4000)) == want
    odd = [[rng.choice([rng.randrange(3, 259), rng.randrange(32000), 2, 1, 0, 259]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    for ids in want + odd:
        assert P.decode_ids(ids, encoder.pieces.surface) == library.decode(ids)


def test_words_leave_when_too_many(model, library, monkeypatch):
    monkeypatch.setattr(P, "HELD", 20)
    encoder, some = P.Encoder(model), texts(60)
    assert [encoder.encode([t])[0] for t in some] == library.encode(some, add_eos=True)
    assert not any(len(w) > P.HELD_CHARS for w in (*encoder.words, *encoder.runs))


def test_a_difference_ends_the_job(model):
    encoder = P.Encoder(model)
    encoder.pieces.rank.pop("▁the")
    with pytest.raises(ValueError):
        encoder.encode(["the end"])


def test_other_models_are_refused(model):
    def changed(change) -> bytes:
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        change(spec)
        return spec.SerializeToString()

    def spaced(spec):
        spec.pieces[500].piece = "a▁b"

    def given(spec):
        spec.pieces[500].type = 4

    def unigram(spec):
        spec.trainer_spec.model_type = 1

    def folded(spec):
        spec.normalizer_spec.remove_extra_whitespaces = True

    for change in (spaced, given, unigram, folded):
        with pytest.raises(ValueError):
            P.Pieces.of(changed(change))


def test_documents(spark, model, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(-1, None, "x"), (None, "hi there", "x"), (3, texts()[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in P.piece_digests(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = P.encode(df, model, df.columns, checked=False).select("_keep.*", F.col("_text").alias("back")).collect()
    assert all(r["back"] == library.decode(library.encode(r["text"] or "")) for r in back)
    assert P.piece_digests(df.limit(0), PATH).count() == 0
