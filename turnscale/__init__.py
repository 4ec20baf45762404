"""turnscale: conversation telemetry and corpus retrieval as Spark DataFrame plans."""
