"""Error classes of the engine."""


class GraphError(Exception):
    """Any error of the engine."""


class ParseError(GraphError):
    """The statement is not in the grammar."""


class SchemaError(GraphError):
    """A label, edge type, property, index or graph is unknown or already exists."""


class ExecutionError(GraphError):
    """The statement cannot be executed."""
