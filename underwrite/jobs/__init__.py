"""Jobs: several tables read and appended as one committed run."""
