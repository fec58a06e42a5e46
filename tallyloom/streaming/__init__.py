"""The bucket counts of the batch analyses over a stream (an extension)."""
