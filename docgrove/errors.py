"""What the library raises."""


class Unsortable(Exception):
    """Documents without a value in the sort index: ``n`` of them, of which ``docids`` lists the first ``SHOWN``."""

    SHOWN = 1000

    def __init__(self, docids: list[int], n: int | None = None) -> None:
        self.docids, self.n = docids, len(docids) if n is None else n
        super().__init__(f"no sort value for {self.n} documents")


class NoResults(Exception):
    """``one()`` of an empty result."""


class MultipleResults(Exception):
    """``one()`` of a result with several documents."""


class ParseError(Exception):
    """A text query that doesn't follow the grammar."""


class QueryError(Exception):
    """A well-formed text query that can't be run."""
