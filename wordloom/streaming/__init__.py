"""Windows over event time, as batch plans that also run on streams."""
