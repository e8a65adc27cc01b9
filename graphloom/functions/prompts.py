"""Texts for models: what a verbaliser is told of an item, by type, with fields in curly brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERBALISE = {
    "chain": "Write one question that starts at {start} and follows these facts to their end, naming none in between:\n{path}\nIts answer is: {answer}",
    "intersection": "Write one question that asks what satisfies all of these:\n{constraints}\nIts answer is: {answer}",
    "comparative": "Write one question on how {left} and {right}, both of the kind {class}, differ in {relation}.\n{left}: {left_values}\n{right}: {right_values}\nIts answer is: {answer}",
    "temporal": "Write one question on {entity}, which began in {year}, and what came of it:\n{developments}{makers}\nIts answer is: {answer}",
    "extremum": "Write one question that needs {operation} over everything known; the result is {answer_value}{extra}.\nIts answer is: {answer}",
    "absence": "Write one question on those whose {pop_rel} is {pop_obj} ({pop_size} of them) but whose {exc_rel} is not {exc_obj}.\nIts answer is: {answer}",
    "mm_chain": "Write one question that starts at {start}, follows these facts, and asks for what a photograph of the last shows:\n{path}\nThe photograph: {caption}\nIts answer is: {answer}",
    "grounded": "Write one question on the {relation} ({value}) of {subject}, beside its photograph.\nIts answer is: {answer}",
    "attribute": "Write one question on the {relation} ({value}) of what a photograph of {subject} shows, without its name.\nIts answer is: {answer}",
    "identify": "Write one question that asks what a photograph of {subject} shows, without its name. Known of it:\n{facts}\nIts answer is: {answer}",
}


def verbalising(kind: Column, fields: Column) -> Column:
    """The prompt of an item of a kind, its fields (map of texts) filled in; null for kinds that there are none of."""
    out = F.lit(None).cast("string")
    for name, body in VERBALISE.items():
        out = F.when(kind == name, F.lit(body)).otherwise(out)
    return F.aggregate(F.map_entries(fields), out, lambda text, x: F.replace(text, F.concat(F.lit("{"), x["key"], F.lit("}")), x["value"]))
