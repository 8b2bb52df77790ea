"""A string-first wrangling and ETL engine that plans everything as Spark DataFrames."""

from .functions.aggregates import Count, First, Last, Mean, StringJoin, Sum
from .functions.expr import Expr, and_, not_, or_
from .plans.pipeline import ErrorLog, MutablePipeline, Pipeline, Transform, concat_pipelines
from .plans.result import Err, Ok, Result
from .table import BinDef, Case, MutableTable, Row, SortKey, Table, asc, cartesian_product, concat, desc, new, new_mutable, union

__all__ = [
    "BinDef", "Case", "Count", "Err", "ErrorLog", "Expr", "First", "Last", "Mean", "MutablePipeline", "MutableTable", "Ok", "Pipeline", "Result", "Row", "SortKey", "StringJoin", "Sum", "Table", "Transform",
    "and_", "asc", "cartesian_product", "concat", "concat_pipelines", "desc", "new", "new_mutable", "not_", "or_", "union",
]
