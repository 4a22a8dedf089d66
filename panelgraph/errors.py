"""Errors a caller can tell apart."""


class PanelError(ValueError):
    """A panel breaks one of its invariants."""


class FoldError(ValueError):
    """A walk-forward layout is impossible or a fold leaves the panel."""


class GraphError(ValueError):
    """A correlation, weight or adjacency table breaks one of its invariants."""


class EvaluationError(ValueError):
    """Predictions do not cover what a comparison needs."""


class MissingArtifactError(FileNotFoundError):
    """A stored table is absent; the message names the step that writes it."""
