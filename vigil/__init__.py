"""vigil: payment-stream anomaly analytics and alert data processing on Spark."""
