"""Sources and sinks: files, probes, masks, checkpoints, audit, encoders."""
