"""Detection and one-way replacement of secrets and personal data, as Spark DataFrame transformations."""

__version__ = "0.2.0"
