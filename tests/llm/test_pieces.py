import os
import random

import pytest

from evidspark.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")
TEXTS = ["", " ", "  a ", "Hello  world\nfoo é漢", "        x                  y", "aaaaaaaaaaaaaaaa", "....!!!!----=======", "\U0001f600 ok\r\n\n\n z", "www.example.com/foo?bar=baz&x=1", "a\x00b"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Model(pieces._read(pieces.MODEL)))


def test_equals_library(codec, spark, data):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("abeinorst éß\n.,漢▁0", k=rng.randint(1, 60))) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for t in texts:
        assert codec.encode(t) == library.encode(t)
        if "▁" not in t:
            assert codec.decode(codec.encode(t)) == t


def test_viterbi_on_unigram_scores(codec):
    """Scores as log-probabilities: the best sum wins, checked against all ways."""
    model = pieces.Model(pieces._read(pieces.MODEL))
    model.bpe = False
    own = pieces.Codec(model)
    rank = own.rank

    def best(word):
        ways = {0: 0.0}
        for i in range(1, len(word) + 1):
            found = [ways[j] + rank[word[j:i]][0] for j in range(i) if j in ways and word[j:i] in rank]
            if found:
                ways[i] = max(found)
        return ways.get(len(word))

    for word in ("▁there", "▁international", "ation", "▁xyzzy"):
        assert sum(rank[own.text[p]][0] for p in own.encode_word(word)) == pytest.approx(best(word))


def test_frames(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *TEXTS])], "doc_id bigint, text string")
    coded = pieces.encode_documents(df)
    back = {r.id: r.text for r in pieces.decode_documents(coded).collect()}
    assert back == {i: t for i, t in enumerate([None, *TEXTS])}
    assert all(r.round_trip for r in pieces.report(df).collect())
    assert pieces.report(df.limit(0)).count() == 0


def test_bounded_memory(codec, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_WORDS", 3)
    words = pieces._Words(codec)
    for w in "abcdefgh":
        words[" " + w]
    assert len(words) <= 3 and len(words.old) <= 3
