"""stepfree: step-free street routing and image-evidence analytics on PySpark."""
