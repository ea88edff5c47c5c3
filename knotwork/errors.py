"""What can go wrong, by layer."""


class GraphError(Exception):
    """Base of all errors of this engine."""


class SchemaError(GraphError):
    """A name or type that the schema does not allow."""


class SchemaConflict(SchemaError):
    """A declaration that contradicts an earlier one."""


class SchemaViolation(SchemaError):
    """Data or a query that contradicts the schema."""


class IntegrityError(GraphError):
    """Data that contradicts other data."""


class NotFound(IntegrityError):
    pass


class DuplicateVertex(IntegrityError):
    pass


class DuplicateEdge(IntegrityError):
    pass


class IncidentEdges(IntegrityError):
    """A vertex to drop still has edges."""


class ReadOnly(GraphError):
    pass


class Conflict(GraphError):
    """Another session committed first; the transaction may be tried again."""


class QueryError(GraphError):
    pass


class TraversalError(QueryError):
    """A traversal that is not well-formed."""


class UnexpectedDataType(QueryError):
    """A step that does not apply to the values it would get."""


class UnsupportedOperation(QueryError):
    pass


class IncompleteLoad(GraphError):
    """A bulk load was committed or left in the wrong order."""


class VectorIndexError(GraphError):
    pass
