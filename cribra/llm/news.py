"""Bodies of the labeled_news articles: wrapper lines off, no prose flagged. Problems 3, 5 and 7 start here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.quality import flag_no_prose
from cribra.llm.wrappers import learn_tokens, pages_of, split_body


def bodies(news: DataFrame) -> DataFrame:
    """news(article_id, text, url, source) -> (article_id, furniture, body). Two passes over the text, a third one over lines out of place."""
    pages = pages_of(news)
    return split_body(pages, learn_tokens(pages))


def judged(news: DataFrame) -> DataFrame:
    """bodies with the statistics of the body, rule and no_prose."""
    return flag_no_prose(bodies(news))


def no_prose(news: DataFrame) -> DataFrame:
    """(article_id) whose body is for the most part a list, a table, links, fields, code or junk."""
    return judged(news).where("no_prose").select("article_id")


def wrapper_lines(news: DataFrame) -> DataFrame:
    """(article_id, line_no) of the lines that aren't part of the body; articles that are no prose have none."""
    return judged(news).where("NOT no_prose").select("article_id", F.explode("furniture").alias("line_no"))
