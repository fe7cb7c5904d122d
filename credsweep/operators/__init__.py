"""DataFrame -> DataFrame stages of the detector."""
