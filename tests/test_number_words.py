"""Number words are looked for by substring before their patterns."""

from pyspark.sql import functions as F

from unitlens.functions.lease import digits_for_words


def test_a_word_that_a_text_lacks_is_not_searched_by_its_pattern(spark):
    texts = ["twenty four months", "none often phone", "one-two ten", "twenty  four and twelve", "", None, "sixteen six", "xone one1 one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(digits_for_words(F.col("t")).alias("d"))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.d for r in df.collect()] == [
        "24 months", "none often phone", "1-2 10", "24 and 12", "", None, "sixteen 6", "xone one1 1"]
