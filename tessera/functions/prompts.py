"""Prompts, provider protocols and identities that jobs put together on the driver, and columns made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canon import record_hash
from tessera.functions.text import admissible_block


# What stands before worked examples, and the form of the answer.
EXAMPLES_HEADING = "\nHere are examples:\n"
ANSWER_FORM = "\nRespond with exactly the next action on a single line, in the form 'Action: <command>'.\n"


def example_lines(examples) -> list[str]:
    """Worked examples, a text, a list, or a mapping whose values count, as a line each; a list inside is one line."""
    if not examples:
        return []
    if isinstance(examples, str):
        return [examples]
    given = examples.values() if hasattr(examples, "values") else examples
    return [x if isinstance(x, str) else "".join(str(part) for part in x) for x in given]


def reference_prompt(instruction: str, examples, heading: str = EXAMPLES_HEADING, answer: str = ANSWER_FORM) -> str:
    lines = example_lines(examples)
    return instruction + "".join([heading, *(f"{line}\n" for line in lines)] if lines else []) + answer


def prompt_version(versions: dict[str, str], name: str) -> str:
    if name not in versions:
        raise ValueError(f"unknown prompt version {name!r}; known: {sorted(versions)}")
    return versions[name]


def prompt_of(versions: dict[str, str], name: Column) -> Column:
    """The prompt of each row's version, null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in sorted(versions.items()) for x in pair])
    return F.try_element_at(table, name)


def first_message(task: Column, observation: Column, actions: Column) -> Column:
    return F.concat(F.lit("Task:\n"), F.trim(task), F.lit("\n\nObservation:\n"), F.trim(observation), F.lit("\n\nAdmissible actions:\n"),
        admissible_block(actions))


def turn_message(observation: Column, actions: Column) -> Column:
    return F.concat(F.lit("Observation:\n"), F.trim(observation), F.lit("\n\nAdmissible actions:\n"), admissible_block(actions))


def choices(message: Column) -> Column:
    """The actions that a message lists under its `Admissible actions:` line."""
    block = F.regexp_extract(message, r"(?s)Admissible actions:\n(.*)$", 1)
    return F.transform(F.filter(F.split(block, "\n"), lambda x: F.startswith(x, F.lit("- "))), lambda x: F.trim(F.substr(x, F.lit(3))))


def query_hash(task: Column, observation: Column, actions: Column, action: Column) -> Column:
    """Identity of what a blind judge sees, and of nothing else."""
    return record_hash(action=action, actions=actions, observation=observation, task=task)


def source_id(group: Column, experiment: Column, unit: Column, sample: Column, kind: str = "source") -> Column:
    return record_hash(kind=F.lit(kind), group=group, experiment=experiment, unit=unit, sample=sample)


def score_id(source: Column, target_kind: Column, target: Column) -> Column:
    return record_hash(kind=F.lit("score"), source=source, target_kind=target_kind, target=target)


def normalised_draw(value: Column) -> Column:
    """struct(action, valid, raw) of JSON text in any of three shapes: a bare action, or records with either set of names."""
    field = lambda name: F.get_json_object(value, f"$.{name}")
    is_record = F.startswith(F.trim(value), F.lit("{"))
    named = F.coalesce(*[F.nullif(F.trim(field(n)), F.lit("")) for n in ("executed_action", "teacher_action", "action")])
    action = F.when(is_record, named).otherwise(F.nullif(F.trim(value), F.lit("")))
    said = F.coalesce(field("valid"), field("teacher_valid"))
    valid = action.isNotNull() & F.when(is_record, F.coalesce(said == "true", F.lit(True))).otherwise(True)
    return F.struct(action.alias("action"), F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(is_record, F.coalesce(field("raw"), field("teacher_raw"))).alias("raw"))


def vocabulary_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens and ids that only one of two vocabularies has."""
    one = lambda x, y, side: x.select("token", "id").exceptAll(y.select("token", "id")).withColumn("side", F.lit(side))
    return one(a, b, "only_first").unionByName(one(b, a, "only_second"))


@dataclass(frozen=True)
class SamplingProtocol:
    """How a provider decodes; unlawful combinations are refused before any call is paid for."""

    thinking: str
    temperature: float | None
    effort: str | None = None

    def violations(self, samples_per_unit: int = 1) -> list[str]:
        warm = self.temperature is not None and 0.0 <= self.temperature <= 2.0
        rules = {
            "samples_not_positive": samples_per_unit <= 0,
            "unknown_mode": self.thinking not in ("enabled", "disabled", "provider_default"),
            "thinking_with_temperature": self.thinking == "enabled" and self.temperature is not None,
            "thinking_without_effort": self.thinking == "enabled" and self.effort not in ("low", "high", "max"),
            "effort_without_thinking": self.thinking != "enabled" and self.effort is not None,
            "temperature_out_of_range": self.thinking != "enabled" and not warm,
            "repeats_at_zero_temperature": self.thinking == "disabled" and samples_per_unit > 1 and self.temperature == 0.0,
        }
        return [name for name, broken in rules.items() if broken]
