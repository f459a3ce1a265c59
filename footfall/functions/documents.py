"""Rows as JSON text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_document(fields: dict[str, Column]) -> Column:
    """Named fields as a JSON object, nulls written out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"})


def visit_document(fields: dict[str, Column]) -> Column:
    """A visit as a JSON object: nulls are written out, except that a missing asn is left out."""
    without_asn = {name: value for name, value in fields.items() if name != "asn"}
    return F.when(fields["asn"].isNull(), json_document(without_asn)).otherwise(json_document(fields))
