"""A PySpark-native document catalog with boolean, faceted and full-text search."""

from .catalog import Catalog, RangeValue
from .errors import MultipleResults, NoResults, ParseError, QueryError, Unsortable
from .functions.analysis import HTML, Analyzer, Custom, DropWords, Lower, Split
from .functions.ranking import Cosine, Okapi
from .operators.indexes import FacetIndex, FieldIndex, KeywordIndex, TextIndex
from .operators.nodes import All, And, Any_, Contains, Eq, Ge, Gt, In, InRange, Le, Lt, Name, Not, NotAll, NotAny, NotContains, NotEq, NotIn, NotInRange, Or
from .results import FWSCAN, NBEST, OPTIMAL, STABLE, TIMSORT, ResultSet

__all__ = [
    "All", "Analyzer", "And", "Any_", "Catalog", "Contains", "Cosine", "Custom", "DropWords", "Eq", "FWSCAN", "FacetIndex", "FieldIndex", "Ge", "Gt", "HTML", "In", "InRange",
    "KeywordIndex", "Le", "Lower", "Lt", "MultipleResults", "NBEST", "Name", "NoResults", "Not", "NotAll", "NotAny", "NotContains", "NotEq", "NotIn", "NotInRange", "OPTIMAL", "Okapi",
    "Or", "ParseError", "QueryError", "RangeValue", "ResultSet", "STABLE", "Split", "TIMSORT", "TextIndex", "Unsortable",
]
