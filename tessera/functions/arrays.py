"""Arrays of numbers and messages: masks, alignments, entropies, vectors, histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def softmax_entropy(scores: Column) -> Column:
    """Entropy, in nats, of the softmax of log scores; shifted by the largest, so large scores don't overflow."""
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    mass = total(weights)
    return -total(F.transform(F.filter(weights, lambda w: w > 0), lambda w: (w / mass) * F.log(w / mass)))


def replace_system(messages: Column, prompt: Column) -> Column:
    """messages with the first one's content replaced; null unless its role is system."""
    first = F.struct(F.lit("system").alias("role"), prompt.alias("content"))
    return F.when(F.get(messages, F.lit(0))["role"] == "system", F.concat(F.array(first), F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))))


def append_action(messages: Column, action: Column) -> Column:
    return F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("Action: "), action).alias("content"))))


def roles_alternate(roles: Column) -> Column:
    """system, user, then assistant and user in turn, ending with user."""
    expected = lambda r, i: F.when(i == 0, r == "system").when(i % 2 == 1, r == "user").otherwise(r == "assistant")
    return (F.size(roles) >= 2) & (F.size(roles) % 2 == 0) & F.forall(F.transform(roles, expected), lambda ok: ok)


def prefix_actions(contents: Column) -> Column:
    """The actions in a history: every second content from the third on, without its marker."""
    return F.transform(F.filter(contents, lambda _, i: (i >= 2) & (i % 2 == 0)), lambda c: F.regexp_replace(c, "^Action: ", ""))


def token_weights(mask: Column, weight: Column) -> Column:
    """The weight spread evenly over masked tokens."""
    n = total(mask)
    return F.transform(mask, lambda m: F.when(n > 0, m * weight / n).otherwise(0.0))


def shifted_left(mask: Column) -> Column:
    """Mask of the positions that predict a masked token: the last predicts none."""
    return F.concat(F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0))), F.array(F.lit(0)))


def response_mask(span: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), span.cast("int")), F.array_repeat(F.lit(0), (length - span).cast("int")))


def aligned(scores: Column, prompt_length: Column, response_length: Column, width: Column) -> Column:
    """Scores of the response's tokens out of a whole sequence's next-token scores, padded with zeros to a width.

    The score of token t stands at t - 1.
    """
    kept = F.slice(scores, prompt_length.cast("int"), response_length.cast("int"))
    return F.concat(kept, F.array_repeat(F.lit(0.0), (width - response_length).cast("int")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero: a direction without length is an error for the caller to count."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def saturated_gap(kl: Column, limit: float = 10.0) -> Column:
    """exp(x) - x - 1, held within the limit."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.exp(kl) - kl - 1))


def supervision_class(text: Column) -> Column:
    return F.when(F.trim(text) == "", "empty").when(F.trim(text).rlike(r"^Action\s*:[^\n]*$"), "action_line").otherwise("whole_response")


def fixed_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based; values are held within the range and the upper end belongs to the last bin."""
    held = F.least(F.greatest(value.cast("double"), F.lit(float(low))), F.lit(float(high)))
    return F.least(F.lit(bins - 1), F.floor((held - low) / (high - low) * bins)).cast("int")


def without_trailing(values: Column, padding: Column) -> Column:
    """values up to the last one that isn't padding."""
    last = F.array_max(F.transform(values, lambda v, i: F.when(v != padding, i + 1).otherwise(0)))
    return F.slice(values, 1, F.coalesce(last, F.lit(0)))


def unwrapped(info: Column) -> Column:
    """A map of one-element lists as a map of their elements."""
    return F.transform_values(info, lambda _, v: F.get(v, F.lit(0)))
