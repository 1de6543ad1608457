import numpy as np
from pyspark.sql import functions as F

from folio.config import ChunkOptions, EmbedOptions
from folio.functions.tokens import arrow_tokenizer
from folio.operators.chunk import chunk_sections
from folio.operators.embed import embed_with_model, hash_embed, normalize_column


def test_user_tokenizer_hook(spark):
    def _whitespace(text):
        return text.split()

    text = " ".join(f"Word{i}, x" for i in range(200))
    df = spark.createDataFrame([("T", "S", text, "u")], "topic string, title string, text string, url string")
    opts = ChunkOptions(max_tokens=50, overlap=10)
    rows = chunk_sections(df, opts, tokenizer=arrow_tokenizer(_whitespace, lower=True)).collect()
    toks = [t.lower() for t in text.split()]
    first = sorted(rows, key=lambda r: r.a)[0]
    assert first.text == " ".join(toks[:48]) and first.tokens == 50


def test_user_model_hook_batches_and_normalizes(spark):
    class _CountModel:
        """A stand-in model: vector = (length, vowel count, 1)."""

        def __call__(self, texts):
            assert len(texts) <= 8
            return np.array([[len(t), sum(c in "aeiou" for c in t), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "banana" * (i + 1)) for i in range(70)], "id int, text string")
    out = embed_with_model(df, _CountModel, options=EmbedOptions(batch_size=8)).collect()
    for r in out:
        v = np.asarray(r.embedding)
        raw = np.array([len(r.text), sum(c in "aeiou" for c in r.text), 1.0])
        np.testing.assert_allclose(v, raw / np.linalg.norm(raw), rtol=1e-6)


def test_truncation_and_normalize_column(spark):
    df = spark.createDataFrame([("a b c d e f",)], "t string")
    full = df.select(hash_embed("t", EmbedOptions(dim=8)).alias("v")).first().v
    cut = df.select(hash_embed("t", EmbedOptions(dim=8, max_seq_length=2)).alias("v")).first().v
    assert full != cut and np.count_nonzero(cut) <= 2
    raw = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    got = [r.embedding for r in normalize_column(raw).collect()]
    np.testing.assert_allclose(got[0], [0.6, 0.8], rtol=1e-6)
    assert got[1] == [0.0, 0.0]
    env = EmbedOptions.resolve(batch_size=None, normalize=None)
    assert env.batch_size == 32 and env.normalize is True
    assert F is not None
