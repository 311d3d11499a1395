"""Plans that span several operators: detection, replayable views, staging."""
