"""Training-data operators: token counts, token files, packing, deduplication,
filters, fingerprints and nearest neighbours over tables of documents.

Nothing outside this folder imports it.  ``queries`` registers the
``opN_<name>`` queries; every operator has its own general interface."""
