"""Errors that the engine raises."""


class KairographError(Exception):
    pass


class StoreNotFound(KairographError):
    """The versioned table doesn't exist or hasn't its columns."""


class ConcurrentWrite(KairographError):
    """Another writer made the commit first; nothing of this one is seen."""


class UnknownMode(KairographError):
    """A version encoding other than decorator or reification."""


class WrongInputFormat(KairographError):
    """Triples or lists of the wrong arity, length or form."""


class ReservedPrefix(KairographError):
    """The prefixes given to a write declare that of the validity predicates."""


class ExpressionNotCovered(KairographError):
    """A property path or expression that isn't supported in this mode."""


class SparqlSyntax(KairographError):
    """A query that doesn't parse."""


class ServiceNotRegistered(KairographError):
    """SERVICE names an endpoint without a registered table."""
