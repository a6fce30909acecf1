"""Sources and sinks: git repositories, the file layout of a dataset, configuration."""
