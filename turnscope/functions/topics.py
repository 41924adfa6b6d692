"""Topic taxonomy and keyword classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "Other"
NOT_TOPICS = ("Other", "Misc")
#: Topics that every per-topic table lists, hit or not.
TAXONOMY = (
    "Travel", "Cars", "Mobile phones", "Gift Suggestion", "Fashion", "Household Work", "Event Planning", "Weather and Climate", "Finance", "Energy",
    "Politics & History", "Games", "Music", "Military", "Health", "Mental Health", "Law", "Security & Privacy", "Scientific Writing", "Books",
    "Programming", "AI", "GPT", "Science", "Physics", "Astrology", "Religion", "Gender and Diversity", "Animals/Pets information", "Art", "Drinks",
    "Languages", "Time conversion", "Math", "Troubleshooting", "Cooking", "Social Media Content Generation", "Email Drafting", "Job Search",
    "Art Generation", "Misc", "Roleplay",
)
#: Names of topics that the two halves of the analysis give differently.
RENAMES = {"decisions": {"GPT": "AI"}, "replay": {"GPT": "OpenAI Product Info"}}


def classify(text: Column, keywords: dict[str, list[str]], default: str = DEFAULT) -> Column:
    """Topic with most distinct keyword hits in the padded lower-case text, the first listed on ties.

    keywords is the taxonomy, in order; it is an input, as deployments differ in it.
    """
    hay = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    if not keywords:
        return F.lit(default)
    scores = [F.aggregate(F.array(*[F.lit(k) for k in ks]), F.lit(0), lambda n, k: n + hay.contains(k).cast("int")) for ks in keywords.values()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(default)
    for topic, score in reversed(list(zip(keywords, scores))):
        out = F.when((score == best) & (best > 0), F.lit(topic)).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(out)


def load_keywords(spark, path: str) -> dict[str, list[str]]:
    """Taxonomy from lines of JSON {"topic": ..., "keywords": [...]}, in file order; a taxonomy is small."""
    rows = spark.read.text(path).select(F.from_json("value", "topic string, keywords array<string>").alias("t")).select("t.*").filter("topic is not null").collect()
    return {r["topic"]: list(r["keywords"] or []) for r in rows}


def rename(topic: Column, where: str) -> Column:
    for old, new in RENAMES[where].items():
        topic = F.when(topic == old, new).otherwise(topic)
    return topic
