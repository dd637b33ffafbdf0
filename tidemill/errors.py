"""The one error that bad input to an operator raises."""


class PreparationError(ValueError):
    """A step, filter, formula or query that cannot be applied as asked."""
