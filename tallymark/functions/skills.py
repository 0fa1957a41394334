"""A lexicon of skills to look for in postings. It is a default: `lexicon` reads any other from a file of one term a line."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Terms as they stand in lower-case text.
TERMS = [
    *"python java javascript typescript golang rust c++ c# ruby php scala kotlin swift perl matlab sql bash html css elixir haskell lua".split(),
    *"react angular vue svelte next.js node.js django flask fastapi spring rails .net laravel flutter tailwind".split(),
    *"postgresql mysql mongodb redis elasticsearch cassandra dynamodb snowflake bigquery redshift databricks spark hadoop kafka airflow dbt flink tableau looker excel pandas numpy".split(),
    *"aws azure gcp docker kubernetes terraform ansible jenkins linux nginx grafana prometheus git graphql grpc ci/cd".split(),
    *"tensorflow pytorch keras scikit-learn nlp llm".split(),
    *"agile scrum kanban jira figma photoshop seo salesforce sap oauth".split(),
    "machine learning", "computer vision", "data science", "data engineering", "data analysis", "data warehousing", "natural language processing", "react native", "power bi", "google cloud", "unit testing",
    "distributed systems", "system design", "project management", "product management", "stakeholder management", "technical writing", "penetration testing", "incident response", "version control",
]


def lexicon(spark: SparkSession, path: str | None = None) -> list[str]:
    """The shipped terms, or those of a file; a lexicon is a list that fits a plan."""
    if path is None:
        return list(TERMS)
    term = F.lower(F.btrim("value"))
    return [r.term for r in spark.read.text(path).select(term.alias("term")).where("term <> '' and term not like '#%'").distinct().orderBy("term").collect()]
