"""DataFrame-in / DataFrame-out operators: transforms, profiles, outliers,
relations, chart data, detectors, time series, segmentation, isolation forest."""
