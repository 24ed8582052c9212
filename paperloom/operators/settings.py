"""Settings as JSON values by key, and the model profiles inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.schema import PROFILE

DEFAULT_PROFILE = {"id": "default", "name": "Default", "provider": "openai", "model": "gpt-4o", "apiKey": "", "baseUrl": "https://api.openai.com/v1", "temperature": 0.7, "maxTokens": 2048, "topK": 0, "systemPrompt": ""}


def setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.where(F.col("key") == key).select("value")


def decoded(settings: DataFrame, key: str) -> DataFrame:
    """The value of a setting decoded from its JSON text: a string or number as plain text, a list or object as JSON; no row for an unknown key."""
    return setting(settings, key).select(F.try_variant_get(F.try_parse_json("value"), "$", "string").alias("value"))


def repointed(selections: DataFrame, known: DataFrame) -> DataFrame:
    """(name, profile_id) with every selection whose profile is gone, or that was never made, moved to the first profile."""
    first = known.agg(F.min_by("id", "pos").alias("_first"))
    there = known.select(F.col("id").alias("profile_id"), F.lit(True).alias("_there"))
    return selections.join(there, "profile_id", "left").join(first, F.lit(True), "left").select("name", F.when(F.col("_there"), F.col("profile_id")).otherwise(F.col("_first")).alias("profile_id"))


def profiles(settings: DataFrame, key: str = "llm_profiles") -> DataFrame:
    """(pos, profile fields) of the saved list."""
    return setting(settings, key).select(F.posexplode(F.from_json("value", f"array<{PROFILE}>")).alias("pos", "p")).select("pos", "p.*")


def migrated(settings: DataFrame) -> DataFrame:
    """One profile from the old single configuration: its fields over the defaults; only where no list is saved."""
    saved = setting(settings, "llm_profiles").agg(F.count("*").alias("n"))
    old = setting(settings, "llm_config").select(F.from_json("value", PROFILE).alias("p"))
    fields = [F.coalesce(F.col(f"p.{k}"), F.lit(v)).alias(k) for k, v in DEFAULT_PROFILE.items()]
    return old.join(saved.where("n = 0").select(F.lit(1).alias("_one")), F.lit(True), "left_semi").select(*fields)


def resolved(requests: DataFrame, known: DataFrame, chat_profile: str | None) -> DataFrame:
    """For each requested id the profile of that id, else the one chosen for chats, else the first."""
    chosen = known.where(F.col("id") == F.lit(chat_profile)).agg(F.min("id").alias("chat_id"))
    first = known.agg(F.min_by("id", "pos").alias("first_id"))
    exact = known.select(F.col("id").alias("profile_id"), F.lit(True).alias("_known"))
    out = requests.join(exact, "profile_id", "left").join(chosen, F.lit(True), "left").join(first, F.lit(True), "left")
    return out.select("request", F.when(F.col("_known"), F.col("profile_id")).otherwise(F.coalesce("chat_id", "first_id")).alias("resolved"))


def _fields() -> list[str]:
    return list(DEFAULT_PROFILE)


def profile_added(known: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (one row of profile fields) at the end of the list."""
    end = known.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos"))
    return known.select("pos", *_fields()).unionByName(new.select(*_fields()).join(end, F.lit(True)).select("pos", *_fields()))


def profile_updated(known: DataFrame, patch: DataFrame) -> DataFrame:
    """Fields of the patch (id and any others) over those of the profile with its id; nulls keep."""
    new = patch.select("id", *(F.col(c).alias(f"_{c}") for c in patch.columns if c != "id"))
    out = known.join(new, "id", "left")
    return out.select("pos", *(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in _fields()))


def profile_removed(known: DataFrame, profile_id: str) -> DataFrame:
    """The list without the profile; the last one stays."""
    several = known.agg((F.count("*") > 1).alias("several"))
    return known.join(several, F.lit(True)).where(~F.col("several") | (F.col("id") != profile_id)).drop("several")


def profile_value(known: DataFrame) -> DataFrame:
    """The list as one setting value."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*_fields()).alias("p"))))
    return known.agg(F.to_json(F.transform(rows, lambda r: r["p"])).alias("value"))


def request_body(provider: Column, model: Column, messages: Column, temperature: Column, max_tokens: Column, top_k: Column) -> Column:
    """The JSON body for a provider: a local server takes options, the others temperature and a token limit, one of them a top-k."""
    limited = F.when(top_k > 0, top_k)
    local = F.to_json(F.struct(model.alias("model"), messages.alias("messages"), F.lit(False).alias("stream"), F.when(top_k > 0, F.struct(top_k.alias("top_k"))).alias("options")))
    hosted = F.to_json(F.struct(model.alias("model"), messages.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens"), F.when(provider == "anthropic", limited).alias("top_k")))
    return F.when(provider == "ollama", local).otherwise(hosted)


def reply_text(provider: Column, body: Column) -> Column:
    """The answer inside a provider's reply, or empty."""
    return F.coalesce(F.when(provider == "ollama", F.get_json_object(body, "$.message.content")).otherwise(F.get_json_object(body, "$.choices[0].message.content")), F.lit(""))
