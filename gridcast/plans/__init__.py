"""Multi-step plans: folds, metrics, baselines, calibration, inference, learners and forecasts."""
