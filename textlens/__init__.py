"""Text analysis over DataFrames of documents."""
