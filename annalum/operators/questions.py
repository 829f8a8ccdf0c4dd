"""Questions by rules: intent, answer format, years asked for, and the searches to run. Where a deployment has a model,
its answer has the same columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalum.functions import years

#: Words that tell an intent, the first that fits; and the format of each intent's answer.
INTENTS = {
    "comparison": ("compare", " versus ", " vs ", "difference between"),
    "connection": ("relationship between", "connected to", "connection between"),
    "causation": ("why ", "cause of", "causes of", "consequence", "led to"),
    "timeline": ("timeline", "chronology", "sequence of", "history of"),
    "map_query": ("where ", "location of", "on a map"),
    "person_info": ("who ", "biography of", "life of"),
    "deep_dive": ("in detail", "explain", "deeply"),
}
FORMATS = {
    "comparison": "comparison_table", "connection": "flow_chart", "causation": "flow_chart", "timeline": "timeline_list",
    "map_query": "map_markers", "person_info": "cards", "deep_dive": "narrative", "overview": "narrative"}


def intent(question: Column) -> Column:
    low = F.lower(question)
    out = F.lit("overview")
    for name, words in reversed(INTENTS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)).otherwise(out)
    return out


def plans(questions: DataFrame, around: int = 50) -> DataFrame:
    """id, intent, format, year_from, year_to, searches, per_search. questions: id, question.

    A year in the question asks for `around` years to each side, a century for its hundred years. Comparisons search
    twice for ten, all others once for twenty. A null question is an overview without years.
    """
    year, mark = years.in_text(F.col("question"))
    out = questions.withColumns({"intent": F.coalesce(intent(F.col("question")), F.lit("overview")), "_y": year, "_c": mark == "century"})
    low = F.when(F.col("_c"), (F.col("_y") - 1) * 100).otherwise(F.col("_y") - around)
    high = F.when(F.col("_c"), F.col("_y") * 100 - 1).otherwise(F.col("_y") + around)
    form = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[F.col("intent")]
    two = F.col("intent") == "comparison"
    return out.select("id", "intent", form.alias("format"), low.cast("long").alias("year_from"), high.cast("long").alias("year_to"), F.when(two, 2).otherwise(1).cast("long").alias("searches"), F.when(two, 10).otherwise(20).cast("long").alias("per_search"))
