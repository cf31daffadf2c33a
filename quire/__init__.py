"""quire: preparation, packing, validation and quality analytics for document corpora on Spark."""
