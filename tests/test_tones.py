import math

from panelloom.operators import tones


def test_lexicon_and_means(spark):
    docs = [(1, "Good good day", "a", 1), (2, "good DAY!", "a", 1), (3, "bad day", "b", 0), (4, "bad", "b", 2), (5, "good bad", None, None), (6, None, "a", 1), (7, "", "b", 0)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string, good int")
    found = {r.word: r.tone for r in tones.learned_lexicon(df, 2).collect()}
    tone = lambda g, b: math.log((g + 1) / (3 + 2)) - math.log((b + 1) / (3 + 2))
    assert {k: round(v, 8) for k, v in found.items()} == {"good": round(tone(2, 0), 8), "bad": round(tone(0, 2), 8), "day": round(tone(2, 1), 8)}
    means = {r.source: (r.n, r.tone) for r in tones.mean_tones(df, tones.learned_lexicon(df, 2), "source").collect()}
    assert means["a"][0] == 5 and abs(means["a"][1] - (3 * tone(2, 0) + 2 * tone(2, 1)) / 5) < 1e-8 and means[None][0] == 2
    assert tones.learned_lexicon(df.limit(0)).count() == 0
