"""stepfold: agent-trajectory analytics as DataFrame -> DataFrame functions on Spark."""
