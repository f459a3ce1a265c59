"""Browser, operating system and device kind of a user agent."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.fixed_values import BOT_TOKENS, BROWSERS, MOBILE_TOKENS, OPERATING_SYSTEMS
from footfall.functions.once import evaluate_once
from footfall.functions.text import contains_any, is_blank


def is_bot(user_agent: Column) -> Column:
    return contains_any(F.lower(user_agent), BOT_TOKENS)


def _first_match(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    names = [F.when(contains_any(text, tokens), F.lit(name)) for name, tokens in table]
    return F.coalesce(*names, F.lit("other"))


def with_device(df: DataFrame, user_agent: str = "user_agent") -> DataFrame:
    """Add browser, os and device_kind. A blank agent is unknown; a bot is one whatever else it claims."""
    agent, text, blank, bot = F.col(user_agent), F.col("_agent"), F.col("_blank"), F.col("_bot")
    judged = df.select("*", evaluate_once(_agent=F.lower(agent), _blank=is_blank(agent), _bot=is_bot(agent)))
    kind = F.when(contains_any(text, MOBILE_TOKENS), "MOBILE").otherwise("DESKTOP")
    return judged.select(
        *df.columns,
        F.when(blank, "unknown").when(bot, "bot").otherwise(_first_match(text, BROWSERS)).alias("browser"),
        F.when(blank, "unknown").otherwise(_first_match(text, OPERATING_SYSTEMS)).alias("os"),
        F.when(blank, "UNKNOWN").when(bot, "BOT").otherwise(kind).alias("device_kind"),
    )
