"""Contact maps and training-data operators on Spark."""

__version__ = "0.2.0"


def version_stamp() -> str:
    """The package's name and version, for headers of outputs."""
    return f"strandweave {__version__}"
