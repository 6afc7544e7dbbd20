"""Folioscope: paged-document retrieval and evidence analytics as Spark DataFrame plans."""
