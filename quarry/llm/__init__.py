"""Training-data operators for corpora of any size; nothing outside this subpackage imports it."""
