"""Schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


S, L, I, B = StringType(), LongType(), IntegerType(), BooleanType()  # noqa: E741
NODES = _struct(node_id=L, kind=S, symbol_kind=S, name=S, type=S, value=S, file=S, line=I, end_line=I)
EDGES = _struct(parent_id=L, child_id=L)
TOKENS = _struct(node_id=L, pos=I, token=S)
ASSIGNMENT = _struct(cluster_id=L, node_id=L)
ROOTS = _struct(cluster_id=L, node_id=L)
TYPES = _struct(type_id=L, namespace=S, name=S, base_id=L, is_generic=B, is_abstract=B, in_source=B)
CLUSTERING = _struct(Clusters=ArrayType(ArrayType(S)), Parents=ArrayType(ArrayType(I)))
