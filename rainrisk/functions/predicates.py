"""User-built attribute filters: nine operators, AND / OR, typed by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "empty", "not_empty")

_PLACE = {"regional": "text", "residencia_dr": "text", "uba_codigo": "text", "uba_nome": "text", "municipio": "text"}
_UNIT = {"rd": "enum", "regiao_id": "number", "regiao_nome": "text", "sigla_rodovia": "text", "escala": "text", "tipo": "text",
         "ac96h_mm": "number", "ac24h_mm": "number"}

# --- fixed values: searchable fields and their types per layer --------------
LAYERS = {
    "roads": {"rodovia": "text", "tipo_pista": "enum", "regional": "enum", "administra": "enum", "municipio": "text",
              "extensao": "number", "monitored": "bool", "region_id": "number"},
    "encosta": _UNIT | {"RAGEO": "number", "trecho_critico_geo": "bool", "intensity_mmh": "number", "cpc": "number"} | _PLACE,
    "inundacao": _UNIT | {"RAHID": "number", "trecho_critico_hid": "bool"} | _PLACE,
    "fireRisk": {"rf_classe": "enum", "rf_valor": "number", "rf_p90": "number", "rf_media": "number", "horizonte": "enum",
                 "rodovia": "text", "sede_regional": "text", "residencia_dr": "text", "uba_codigo": "text", "uba_nome": "text",
                 "municipio": "text", "jurisdicao": "text", "conservado_por": "text", "data_referencia": "text"},
}


def field_column(layer: str, field: str, columns: list[str]) -> Column | None:
    """Column of a field, None when absent; the level resolves to the channel of the layer."""
    if field == "rd" and layer in ("encosta", "inundacao"):
        own = "rd_geo" if layer == "encosta" else "rd_hid"
        found = [F.col(c) for c in (own, "rd") if c in columns]
        return F.coalesce(*found) if found else None
    return F.col(field) if field in columns else None


def _number(target) -> float | None:
    try:
        return float(str(target).strip() or 0)
    except ValueError:
        return None


def condition(value: Column | None, op: str, target, kind: str = "text") -> Column:
    """One atom as a non-null boolean Column; an absent field never passes a number test."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if value is None:
        if kind == "number" and op not in ("empty", "not_empty"):
            return F.lit(False)
        value = F.lit(None)
    as_text = value.cast("string")
    if op in ("empty", "not_empty"):
        empty = value.isNull() | (as_text == "") | (as_text == "NaN")
        return F.coalesce(empty if op == "empty" else ~empty, F.lit(op == "empty"))
    if kind == "bool":
        have = F.coalesce(as_text.isin("true", "1"), F.lit(False))
        want = F.lit(target in ("true", "1"))
        return have == want if op == "eq" else have != want
    if kind == "number":
        wanted = _number(target)
        if wanted is None or wanted != wanted:
            return F.lit(False)
        want = F.lit(wanted)
        # null and empty text read as zero
        have = F.when(value.isNull() | (F.trim(as_text) == ""), F.lit(0.0)).otherwise(as_text.try_cast("double"))
        tests = {"eq": have == want, "ne": have != want, "gt": have > want, "gte": have >= want, "lt": have < want, "lte": have <= want}
        ok = have.isNotNull() & ~F.isnan(have)
        return F.coalesce(ok & tests[op], F.lit(False)) if op in tests else F.lit(False)
    have, want = F.lower(F.coalesce(as_text, F.lit(""))), F.lit("" if target is None else str(target).lower())
    return {"eq": have == want, "ne": have != want, "contains": F.contains(have, want)}.get(op, F.lit(False))


def rule_column(rule: dict, columns: list[str]) -> Column:
    """``{layerId, join, conditions: [{field, op, value}]}`` as one boolean Column; no condition is true."""
    layer = rule["layerId"]
    fields = LAYERS.get(layer)
    if not fields or not rule.get("conditions"):
        return F.lit(True)
    atoms = [condition(field_column(layer, c["field"], columns), c["op"], c.get("value"), fields.get(c["field"], "text"))
             for c in rule["conditions"]]
    either = rule.get("join") == "or"
    return reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), atoms)


def search(df: DataFrame, layer: str, rules: list[dict]) -> DataFrame:
    """Rows of a layer that satisfy its active rule; a layer without a rule passes whole."""
    rule = next((r for r in rules if r["layerId"] == layer), None)
    return df if rule is None else df.where(rule_column(rule, df.columns))


def simple_search(df: DataFrame, layer: str, field: str, value) -> DataFrame:
    return search(df, layer, [{"layerId": layer, "join": "and", "conditions": [{"field": field, "op": "eq", "value": value}]}])


def field_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct non-empty values as text, sorted."""
    text = F.col(field).cast("string")
    return df.where(text.isNotNull() & (text != "")).select(text.alias("value")).distinct().orderBy("value")


def road_filter(df: DataFrame, tipo_pista: str | None = None, regional: str | None = None, administra: str | None = None,
                name: str | None = None) -> DataFrame:
    """Up to three equalities and a substring of the road name."""
    for column, wanted in (("tipo_pista", tipo_pista), ("regional", regional), ("administra", administra)):
        if wanted:
            df = df.where(F.col(column) == wanted)
    return df.where(F.contains(F.lower("rodovia"), F.lit(name.lower()))) if name else df


def normalized_roads(df: DataFrame, aliases: dict[str, tuple[list[str], object]]) -> DataFrame:
    """Attributes from the first naming style present, else a default."""
    cols = []
    for name, (sources, default) in aliases.items():
        have = [F.col(c) for c in sources if c in df.columns]
        cols.append(F.coalesce(*have, F.lit(default)).alias(name))
    return df.select(*cols)
