"""Training-data operators over documents and conversations. Nothing else in tessella imports this subpackage."""
