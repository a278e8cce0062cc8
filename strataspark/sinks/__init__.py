"""Writers of model files. A file is a table of lines, sorted over all tasks."""
