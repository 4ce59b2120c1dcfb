"""Jobs that write: publishing, the connector store and the run itself."""
