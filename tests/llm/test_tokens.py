import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urban_spark.llm import tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", " a  b \n\n c", "</s> a<s><unk>", "▁▁a ▁", "a\x1cb\x85c\xa0d 中文 x́", "\na", "a\n", "x" * 20_000, "word " * 8_000, "\x00 a\x00"]


def library(text):
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text or ""))


def test_same_as_library(spark, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "again", None, 2), (3, "again", None, 2), (None, "no id", None, 3)]
    want = sorted((i is None, i or 0, len((t or "").encode()), library(t)) for i, t, *_ in rows)
    for head in (tokens.HEAD, 3):  # with few frequent pre-tokens most counts come by the join
        monkeypatch.setattr(tokens, "HEAD", head)
        out = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, piece string, n_tokens int"), MODEL).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in out)


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab<s>/\t"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pre_tokens_add_up(text):
    pieces = tokens.pre_tokens(text)
    assert sum(tokens.piece_counts(MODEL, pieces)) + text.count("\n") == library(text)


def test_head_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD", 2)
    monkeypatch.setattr(tokens, "LONG", 0)
    table = spark.createDataFrame([(f"p{i}", 1 << i, 1) for i in range(8)] + [("y" * 99, 10**6, 1)], "piece string, n long, tokens long")
    assert set(tokens._most_frequent(table)) == {"p7", "p6"}
    assert pytest.approx(8) == len(tokens.PRE_TOKEN.findall(" a b\nc d  e f g h"))


def test_long_frequent_pre_tokens_and_models(spark, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 2)
    text = ("=" * 200 + " a\n") * 30 + "-" * 90
    out = tokens.token_counts(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), MODEL).collect()
    import sentencepiece

    count = len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text))
    assert [r.n_tokens for r in out] == [count] * 2
    real = tokens._model(MODEL)

    class Other:
        normalize, get_piece_size = real.normalize, real.get_piece_size

        def id_to_piece(self, i):
            return "a▁b" if i == 700 else real.id_to_piece(i)

    tokens.check_model(MODEL)
    monkeypatch.setitem(tokens._models, "other", Other())
    with pytest.raises(ValueError):
        tokens.check_model("other")
