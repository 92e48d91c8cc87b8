"""Column expressions over JSON text and VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """The text as one VARIANT value, or NULL where it is not exactly one JSON value.

    Spark's parsers stop after the first value and ignore what follows. Inside brackets the
    rest shows up as a second item, or breaks the parse; a text that closes the bracket itself
    cannot also be one member of an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one_item = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    one_member = F.size(F.try_variant_get(member, "$", "map<string,variant>")) == 1
    return F.when(one_item & one_member, F.try_variant_get(listed, "$[0]", "variant"))


def is_truthy(value: Column) -> Column:
    """JavaScript truth of a VARIANT: missing, null, "", 0 and false are false."""
    falsy = ('""', "0", "-0", "0.0", "-0.0", "false")
    return F.coalesce(~F.is_variant_null(value) & ~F.to_json(value).isin(*falsy), F.lit(False))


def kind_of(value: Column) -> Column:
    """Type name of a VARIANT, such as STRING, VOID or OBJECT<...>."""
    return F.schema_of_variant(value)


def keys_in_order(values: Column, told: Column) -> Column:
    """The keys of a map that a VARIANT gave, in the order in which the text tells them."""
    known = F.map_keys(values)
    return F.array_union(F.array_intersect(F.coalesce(told, F.array().cast("array<string>")), known), known)


def text_list(item: Column, kind: Column) -> Column:
    """A VARIANT of this kind as a list of texts: one text is a list of it, null an empty list, other things are NULL."""
    return (
        F.when(F.coalesce(kind == "VOID", F.lit(True)), F.array().cast("array<string>"))
        .when(kind == "STRING", F.array(item.cast("string")))
        .when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(item, "$", "array<string>"))
    )


def text_lists(values: Column, keys: Column) -> Column:
    """A map of VARIANTs as a map of lists of texts, its keys in the given order; what is no list of texts is NULL in it."""
    kinds = F.transform(keys, lambda key: F.struct(values[key].alias("item"), F.schema_of_variant(values[key]).alias("kind")))
    return F.map_from_arrays(keys, F.transform(kinds, lambda each: text_list(each["item"], each["kind"])))
