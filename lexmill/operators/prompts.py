"""The contract of prompts: what each must hold, and one mark for what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

UNVERSIONED = "unversioned"
# Fixed values that results depend on: how a component names its version.
VERSION = [r"(?imU)^[ \t]*>[ \t]*\*?\*?vers[aã]o\*?\*?[ \t]*:[ \t]*([^\n\r]+)$", r"(?imU)^[ \t]*\*?\*?vers[aã]o\*?\*?[ \t]*:[ \t]*([^\n\r]+)$", r"(?isU)<!--\s*version\s*:\s*([^-]+?)\s*-->"]


def component_version(content: Column) -> Column:
    """The version that a component names, without stars and blanks; `unversioned` if it names none."""
    clean = lambda c: F.nullif(strip(F.trim(strip(c), F.lit("*"))), F.lit(""))
    return F.coalesce(*(clean(F.regexp_extract(content, p, 1)) for p in VERSION), F.lit(UNVERSIONED))


def prompt_gaps(components: DataFrame, required: DataFrame) -> DataFrame:
    """(prompt, complete boolean, missing array<string>, unmarked array<string>) of every prompt: required components that it hasn't got (or blank), and `component: marker`
    for those that lack a marker, whatever their case; sorted.

    components(prompt, component, content) and required(component, marker), a null marker asking for the component alone.  A prompt is complete when nothing that is required
    is missing: a division by the required rows, which are a small dimension held against each prompt's own components.  A prompt without any component isn't known.
    """
    held = components.where(strip(F.coalesce("content", F.lit(""))) != "").groupBy("prompt", "component").agg(F.max(F.lower("content")).alias("content"))
    wanted = components.select("prompt").distinct().join(required.select("component", F.lower("marker").alias("low"), "marker").distinct())
    met = wanted.join(held, ["prompt", "component"], "left")
    missing = F.when(F.col("content").isNull(), F.col("component"))
    unmarked = F.when(F.col("content").isNotNull() & F.col("low").isNotNull() & ~F.contains("content", "low"), F.concat_ws(": ", "component", "marker"))
    out = met.groupBy("prompt").agg(F.array_sort(F.collect_set(missing)).alias("missing"), F.array_sort(F.collect_set(unmarked)).alias("unmarked"))
    return out.select("prompt", ((F.size("missing") == 0) & (F.size("unmarked") == 0)).alias("complete"), "missing", "unmarked")


def prompt_signatures(components: DataFrame) -> DataFrame:
    """(prompt, components long, version, sha256) of components(prompt, component, content): blank ones don't count, the order of rows doesn't matter.

    sha256 is that of `[name]` and stripped content of all components by name, parted by blank lines; version the one that all name, else `composite:` and all, sorted; both say
    so where there is nothing.
    """
    own = components.withColumn("content", strip(F.coalesce("content", F.lit("")))).where("content <> ''")
    part = F.struct(F.col("component").alias("c"), F.concat(F.lit("["), "component", F.lit("]\n"), "content").alias("t"))
    made = own.groupBy("prompt").agg(F.count("*").alias("components"), F.array_sort(F.collect_list(part)).alias("parts"), F.array_sort(F.collect_set(component_version(F.col("content")))).alias("v"))
    every = components.select("prompt").distinct().join(made, "prompt", "left")
    version = F.when(F.size("v") == 1, F.col("v")[0]).when(F.size("v") > 1, F.concat(F.lit("composite:"), F.array_join("v", ","))).otherwise(UNVERSIONED)
    return every.select("prompt", F.coalesce("components", F.lit(0)).alias("components"), version.alias("version"),
                        F.coalesce(F.sha2(F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n"), 256), F.lit("")).alias("sha256"))


def user_content(task: Column, context: Column) -> Column:
    """A task, after its context where there is any."""
    own, more = strip(F.coalesce(task, F.lit(""))), strip(F.coalesce(context, F.lit("")))
    return F.when(more == "", own).otherwise(F.concat(F.lit("[CONTEXTO ADICIONAL]\n"), more, F.lit("\n\n[TAREFA]\n"), own))


def assemble_prompts(requests: DataFrame, components: DataFrame, stages: dict[str, str], with_references: tuple[str, ...] = (), minimal: str | None = None) -> DataFrame:
    """(request_id, profile, messages array<struct<role, content>>) of requests(request_id, prompt, stage, task, context, references boolean or null).

    Each request is joined with the components(prompt, component, content) of its prompt, one row a prompt: system_base and the component that `stages` names for its stage
    (any case) make a modular prompt, with referencias_longas where the request asks for it or, where it says nothing, in the stages of with_references; where one of the two is missing or
    blank the prompt's SYSTEM_PROMPT takes their place, else the minimal text, else there are no messages (profile `missing`).  The user's content comes last.
    """
    held = components.where(strip(F.coalesce("content", F.lit(""))) != "").groupBy("prompt").agg(F.map_from_entries(F.collect_list(F.struct("component", strip(F.col("content"))))).alias("held"))
    got = lambda name: F.try_element_at("held", name)
    stage = F.lower(F.trim("stage"))
    own = F.coalesce(*(F.when(stage == k, F.lit(v)) for k, v in stages.items()), F.lit(""))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = requests.join(held, "prompt", "left").withColumns({"_base": got(F.lit("system_base")), "_stage": F.try_element_at("held", own), "_old": got(F.lit("SYSTEM_PROMPT")), "_more": got(F.lit("referencias_longas")),
                                                              "_wants": F.coalesce("references", stage.isin(*with_references) if with_references else F.lit(False))})
    modular = F.col("_base").isNotNull() & F.col("_stage").isNotNull()
    user = message("user", user_content(F.col("task"), F.col("context")))
    more = F.when(F.col("_wants") & F.col("_more").isNotNull(), F.array(message("developer", F.col("_more")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    said = F.when(modular, F.concat(F.array(message("system", F.col("_base")), message("developer", F.col("_stage"))), more, F.array(user))).when(F.col("_old").isNotNull(), F.array(message("system", F.col("_old")), user))
    profile = F.when(modular, "modular").when(F.col("_old").isNotNull(), "legacy-fallback")
    if minimal is not None:
        said, profile = F.coalesce(said, F.array(message("system", F.lit(minimal)), user)), F.coalesce(profile, F.lit("minimal-fallback"))
    return rows.select("request_id", F.coalesce(profile, F.lit("missing")).alias("profile"), said.alias("messages"))
